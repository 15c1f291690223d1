"""Fixed values of the project registry: names, spellings and match rules."""

from __future__ import annotations

# The curated projects, in registry order
PROJECT_NAMES = [
    "SMART WORLD DXP", "M3M MANSION", "M3M CAPITAL", "M3M CROWN", "PURI DIPLOMACTIC",
    "TASHEE CAPITAL GATWAY", "ENGIMA", "ELAN THE PRESIDENTIAL", "SOBHA CITY", "GODREJ MERIDIAN",
    "HERO HOMES", "BPTP AMTORIA", "M3M WOODSHIRE", "ATS KOCOON", "WINDCHINTS",
    "IMPERIAL GARDEN", "TATA GURGAON GATEWAY", "INDIABULLS OFFICE SPACE", "ANSAL HIGHLAND PARK",
    "SHAHPURJEE", "SATYA HIVE SEC102", "HEART SONG", "KRUSIMI", "HERITAGE MAX", "PARAS",
    "G 99 PLOT", "EXPERION WESTILIZE", "PURI EMERALD BAY", "TATA LA VIDA", "KASHISH MANON ONE",
    "RAJEJA VANYA PLOT", "PLAZA SEC 106", "ASSOTECH BLITH", "GURGAON GREENS", "M3M CAPITAL WALK",
    "GODREJ ZENITH", "MAX 360", "SOBHA VILLA", "M3M SOLITUDE", "COSMOS EXPRESS", "GODREJ ICON",
    "EMAAR EBD SCO 114", "DIPLOMACTIC GREEN NEW", "ATS TRIMPH", "ATS TOURMOLINE", "HCBS",
    "SATYA MERINO", "VIENNA GREENS", "PAREENA COBAN", "INDIA BULLS HIGHTS",
    "INDIABULLS CLUB & ESTATE", "SIGNATURE DXP", "KIMBERLY SUITES", "WESTIN",
]

# Spellings brought to one form in a normalised name, in order
SPELLINGS = [
    (r"\bSMART WORLD\b", "SMARTWORLD"),
    (r"\bINDIA BULLS?\b", "INDIABULLS"),
    (r"\bKRUSIMI\b", "KRISUMI"),
    (r"\bENGIMA\b", "ENIGMA"),
    (r"\bDIPLOMACTIC\b", "DIPLOMATIC"),
    (r"\bGATWAY\b", "GATEWAY"),
    (r"\bTAASHI\b|\bTASHI\b", "TASHEE"),
    (r"\bAMTORIA\b", "AMSTORIA"),
    (r"\bMERIDIAN\b", "MERIDIEN"),
    (r"\bEMARALD\b|\bEMRALD\b", "EMERALD"),
    (r"\bKOCOON\b|\bKUCOON\b", "KOCOON"),
    (r"\bTRIMPH\b", "TRIUMPH"),
    (r"\bTOURMOLINE\b", "TOURMALINE"),
    (r"\bWINDCHINTS?\b|\bWINDCHANTS?\b", "WINDCHANTS"),
    (r"\bWESTILIZE\b", "WESTERLIES"),
    (r"\bSOULITUDE\b", "SOLITUDE"),
    (r"\bMANON\b", "MANOR"),
    (r"\bRAJEJA\b", "RAHEJA"),
    (r"\bMARENO\b", "MERINO"),
    (r"\bHIGHTS\b", "HEIGHTS"),
    (r"\bPAREENA\b", "PAREENA"),
]

# A project named anywhere in a message; the first hit wins
TEXT_RULES = [
    (r"\bM3M\s+CAPITAL\s+WALK\b", "M3M CAPITAL WALK"),
    (r"\bSMART\s*WORLD\s+(?:ONE\s+)?DXP\b", "SMART WORLD DXP"),
    (r"\bONE\s+DXP\b", "SMART WORLD DXP"),
    (r"\bM3M\s+MANSION\b", "M3M MANSION"),
    (r"\bM3M\s+CAPITAL\b", "M3M CAPITAL"),
    (r"\bM3M\s+CROWN\b", "M3M CROWN"),
    (r"\bPURI\s+DIPLOMAT?IC(?:\s+RESIDENCES?)?\b", "PURI DIPLOMACTIC"),
    (r"\bDIPLOMAT?IC\s+GREENS?\b", "DIPLOMACTIC GREEN NEW"),
    (r"\bTASHEE\s+CAPITAL\s+GATE?WAY\b", "TASHEE CAPITAL GATWAY"),
    (r"\bENIGMA\b|\bENGIMA\b", "ENGIMA"),
    (r"\bELAN\s+(?:THE\s+)?PRESIDENTIAL\b", "ELAN THE PRESIDENTIAL"),
    (r"\bSOBHA\s+CITY\b", "SOBHA CITY"),
    (r"\bGODREJ\s+MERIDI?EN\b", "GODREJ MERIDIAN"),
    (r"\bHERO\s+HOMES?\b", "HERO HOMES"),
    (r"\bBPTP\s+AM[S]?TORIA\b", "BPTP AMTORIA"),
    (r"\bM3M\s+WOODSHIRE\b", "M3M WOODSHIRE"),
    (r"\bATS\s+K[O|U]COON\b", "ATS KOCOON"),
    (r"\bWINDCH[A|I]NTS?\b", "WINDCHINTS"),
    (r"\bIMPERIAL\s+GARDENS?\b", "IMPERIAL GARDEN"),
    (r"\bTATA\s+GURGAON\s+GATEWAY\b", "TATA GURGAON GATEWAY"),
    (r"\bINDIABULLS\s+OFFICE\b", "INDIABULLS OFFICE SPACE"),
    (r"\bANSAL\s+HIGHLAND\s+PARK\b", "ANSAL HIGHLAND PARK"),
    (r"\b(SHAPOORJI|SHAHPURJEE|SHAPURJI)\b", "SHAHPURJEE"),
    (r"\bSATYA\s+HIVE\b", "SATYA HIVE SEC102"),
    (r"\bHEART\s*SONG\b", "HEART SONG"),
    (r"\b(KRISUMI|KRUSIMI)\b", "KRUSIMI"),
    (r"\bHERITAGE\s+MAX\b", "HERITAGE MAX"),
    (r"\bPARAS\b", "PARAS"),
    (r"\bG\s*99\b", "G 99 PLOT"),
    (r"\bEXPERION\s+WESTERLIES\b|\bEXPERION\s+WESTILIZE\b", "EXPERION WESTILIZE"),
    (r"\bPURI\s+EMERALD\s+BAY\b", "PURI EMERALD BAY"),
    (r"\bTATA\s+LA\s+VIDA\b", "TATA LA VIDA"),
    (r"\bKASHISH\s+MANOR\s+ONE\b|\bKASHISH\s+MANON\s+ONE\b", "KASHISH MANON ONE"),
    (r"\bRA[H|J]EJA\s+VANYA\b", "RAJEJA VANYA PLOT"),
    (r"\bPLAZA\s*(?:SEC(?:TOR)?)?\s*106\b", "PLAZA SEC 106"),
    (r"\bASSOTECH\s+BLITH\b", "ASSOTECH BLITH"),
    (r"\bGURGAON\s+GREENS?\b", "GURGAON GREENS"),
    (r"\bGODREJ\s+ZENITH\b", "GODREJ ZENITH"),
    (r"\bMAX\s*360\b", "MAX 360"),
    (r"\bSOBHA\s+VILLA\b", "SOBHA VILLA"),
    (r"\bM3M\s+SOLITUDE\b|\bM3M\s+SOULITUDE\b", "M3M SOLITUDE"),
    (r"\bCOSMOS\s+EXPRESS\b", "COSMOS EXPRESS"),
    (r"\bGODREJ\s+ICON\b", "GODREJ ICON"),
    (r"\bEMAAR\s+EBD\b|\bEBD\s*(?:SCO\s*)?114\b", "EMAAR EBD SCO 114"),
    (r"\bATS\s+TRI?UMPH\b", "ATS TRIMPH"),
    (r"\bATS\s+TOURMALINE\b|\bATS\s+TOURMOLINE\b", "ATS TOURMOLINE"),
    (r"\bHCBS\b", "HCBS"),
    (r"\bSATYA\s+M[E|A]RINO\b", "SATYA MERINO"),
    (r"\bVIENNA\s+GREENS?\b", "VIENNA GREENS"),
    (r"\bPAREENA\s+COBAN\b", "PAREENA COBAN"),
    (r"\bINDIABULLS\s+CLUB\s*(?:&|AND)?\s*ESTATE\b", "INDIABULLS CLUB & ESTATE"),
    (r"\bINDIA\s*BULLS?\s+H[E|I]IGHTS?\b", "INDIA BULLS HIGHTS"),
    (r"\bSIGNATURE\s+(?:GLOBAL\s+)?(?:DE\s*LUXE\s+)?DXP\b", "SIGNATURE DXP"),
    (r"\bKIMBERLY\s+SUITES?\b", "KIMBERLY SUITES"),
    (r"\bWESTIN\b", "WESTIN"),
]

# A normalised name that holds all of the texts belongs to the
# project; the first hit wins.  Blanks around a text make it a whole word.
NAME_RULES = [
    ("M3M CAPITAL WALK", ["M3M", "CAPITAL", "WALK"]),
    ("SMART WORLD DXP", ["SMARTWORLD", "DXP"]),
    ("M3M MANSION", ["M3M", "MANSION"]),
    ("M3M CAPITAL", ["M3M", "CAPITAL"]),
    ("M3M CROWN", ["M3M", "CROWN"]),
    ("PURI DIPLOMACTIC", ["PURI", "DIPLOMATIC"]),
    ("DIPLOMACTIC GREEN NEW", ["DIPLOMATIC", "GREEN"]),
    ("TASHEE CAPITAL GATWAY", ["TASHEE", "CAPITAL", "GATEWAY"]),
    ("ENGIMA", ["ENIGMA"]),
    ("ELAN THE PRESIDENTIAL", ["ELAN", "PRESIDENTIAL"]),
    ("SOBHA CITY", ["SOBHA CITY"]),
    ("GODREJ MERIDIAN", ["GODREJ", "MERIDIEN"]),
    ("HERO HOMES", ["HERO", "HOME"]),
    ("BPTP AMTORIA", ["BPTP", "AMSTORIA"]),
    ("M3M WOODSHIRE", ["M3M", "WOODSHIRE"]),
    ("ATS KOCOON", ["ATS", "KOCOON"]),
    ("WINDCHINTS", ["WINDCHANTS"]),
    ("IMPERIAL GARDEN", ["IMPERIAL", "GARDEN"]),
    ("TATA GURGAON GATEWAY", ["TATA", "GURGAON", "GATEWAY"]),
    ("INDIABULLS OFFICE SPACE", ["INDIABULLS", "OFFICE"]),
    ("ANSAL HIGHLAND PARK", ["ANSAL", "HIGHLAND", "PARK"]),
    ("SHAHPURJEE", [" SHAPOORJI "]),
    ("SHAHPURJEE", [" SHAHPURJEE "]),
    ("SHAHPURJEE", [" SHAPURJI "]),
    ("SATYA HIVE SEC102", ["SATYA", "HIVE"]),
    ("HEART SONG", ["HEART", "SONG"]),
    ("KRUSIMI", ["KRISUMI"]),
    ("HERITAGE MAX", ["HERITAGE", "MAX"]),
    ("PARAS", [" PARAS "]),
    ("G 99 PLOT", [" G 99 "]),
    ("G 99 PLOT", [" G99 "]),
    ("EXPERION WESTILIZE", ["EXPERION", "WESTERLIES"]),
    ("PURI EMERALD BAY", ["PURI", "EMERALD", "BAY"]),
    ("TATA LA VIDA", ["TATA", "LA", "VIDA"]),
    ("KASHISH MANON ONE", ["KASHISH", "MANOR", "ONE"]),
    ("RAJEJA VANYA PLOT", ["RAHEJA", "VANYA"]),
    ("PLAZA SEC 106", ["PLAZA", " 106 "]),
    ("ASSOTECH BLITH", ["ASSOTECH", "BLITH"]),
    ("GURGAON GREENS", ["GURGAON", "GREEN"]),
    ("GODREJ ZENITH", ["GODREJ", "ZENITH"]),
    ("MAX 360", ["MAX", "360"]),
    ("SOBHA VILLA", ["SOBHA", "VILLA"]),
    ("M3M SOLITUDE", ["M3M", "SOLITUDE"]),
    ("COSMOS EXPRESS", ["COSMOS", "EXPRESS"]),
    ("GODREJ ICON", ["GODREJ", "ICON"]),
    ("EMAAR EBD SCO 114", ["EMAAR", "114", "EBD"]),
    ("EMAAR EBD SCO 114", ["EMAAR", "114", "SCO"]),
    ("EMAAR EBD SCO 114", ["EMAAR", "114", "BUSINESS", "DISTRICT"]),
    ("ATS TRIMPH", ["ATS", "TRIUMPH"]),
    ("ATS TOURMOLINE", ["ATS", "TOURMALINE"]),
    ("HCBS", [" HCBS "]),
    ("SATYA MERINO", ["SATYA", "MERINO"]),
    ("VIENNA GREENS", ["VIENNA", "GREEN"]),
    ("PAREENA COBAN", ["PAREENA", "COBAN"]),
    ("INDIABULLS CLUB & ESTATE", ["INDIABULLS", "CLUB", "ESTATE"]),
    ("INDIA BULLS HIGHTS", ["INDIABULLS", "HEIGHT"]),
    ("SIGNATURE DXP", ["SIGNATURE", "DXP"]),
    ("KIMBERLY SUITES", ["KIMBERLY", "SUITE"]),
    ("WESTIN", [" WESTIN "]),
]
