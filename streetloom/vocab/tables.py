"""Controlled vocabularies of US postal addressing.

One plain row for each entry; all lookups are derived from the rows. Most spellings are those of the public postal
addressing standard; some misspellings (DELEWARE, NUNAVAT) are required because records hold them.
"""

from __future__ import annotations

# Street suffixes with their primary name, short form and further spellings.
SUFFIXES = [
    ("ALLEY", "ALY", "ALLEE ALLY"),
    ("ANEX", "ANX", "ANNEX ANNX"),
    ("ARCADE", "ARC", ""),
    ("AVENUE", "AVE", "AV AVEN AVENU AVN AVNUE"),
    ("BAYOU", "BYU", "BAYOO"),
    ("BEACH", "BCH", ""),
    ("BEND", "BND", ""),
    ("BLUFF", "BLF", "BLUF"),
    ("BLUFFS", "BLFS", ""),
    ("BOTTOM", "BTM", "BOT BOTTM"),
    ("BOULEVARD", "BLVD", "BOUL BOULV"),
    ("BRANCH", "BR", "BRNCH"),
    ("BRIDGE", "BRG", "BRDGE"),
    ("BROOK", "BRK", ""),
    ("BROOKS", "BRKS", ""),
    ("BURG", "BG", ""),
    ("BURGS", "BGS", ""),
    ("BYPASS", "BYP", "BYPA BYPAS BYPS"),
    ("CAMP", "CP", "CMP"),
    ("CANYON", "CYN", "CANYN CNYN"),
    ("CAPE", "CPE", ""),
    ("CAUSEWAY", "CSWY", "CAUSWA"),
    ("CENTER", "CTR", "CEN CENT CENTR CENTRE CNTER CNTR"),
    ("CENTERS", "CTRS", ""),
    ("CIRCLE", "CIR", "CIRC CIRCL CRCL CRCLE"),
    ("CIRCLES", "CIRS", ""),
    ("CLIFF", "CLF", ""),
    ("CLIFFS", "CLFS", ""),
    ("CLUB", "CLB", ""),
    ("COMMON", "CMN", ""),
    ("COMMONS", "CMNS", ""),
    ("CORNER", "COR", ""),
    ("CORNERS", "CORS", ""),
    ("COURSE", "CRSE", ""),
    ("COURT", "CT", ""),
    ("COURTS", "CTS", ""),
    ("COVE", "CV", ""),
    ("COVES", "CVS", ""),
    ("CREEK", "CRK", ""),
    ("CRESCENT", "CRES", "CRSENT CRSNT"),
    ("CREST", "CRST", ""),
    ("CROSSING", "XING", "CRSSNG"),
    ("CROSSROAD", "XRD", ""),
    ("CROSSROADS", "XRDS", ""),
    ("CURVE", "CURV", ""),
    ("DALE", "DL", ""),
    ("DAM", "DM", ""),
    ("DIVIDE", "DV", "DIV DVD"),
    ("DRIVE", "DR", "DRIV DRV"),
    ("DRIVES", "DRS", ""),
    ("ESTATE", "EST", ""),
    ("ESTATES", "ESTS", ""),
    ("EXPRESSWAY", "EXPY", "EXP EXPR EXPRESS EXPW"),
    ("EXTENSION", "EXT", "EXTN EXTNSN"),
    ("EXTENSIONS", "EXTS", ""),
    ("FALL", "FALL", ""),
    ("FALLS", "FLS", ""),
    ("FERRY", "FRY", "FRRY"),
    ("FIELD", "FLD", ""),
    ("FIELDS", "FLDS", ""),
    ("FLAT", "FLT", ""),
    ("FLATS", "FLTS", ""),
    ("FORD", "FRD", ""),
    ("FORDS", "FRDS", ""),
    ("FOREST", "FRST", "FORESTS"),
    ("FORGE", "FRG", "FORG"),
    ("FORGES", "FRGS", ""),
    ("FORK", "FRK", ""),
    ("FORKS", "FRKS", ""),
    ("FORT", "FT", "FRT"),
    ("FREEWAY", "FWY", "FRWY FRWAY FREEWY"),
    ("GARDEN", "GDN", "GRDN GARDN GRDEN"),
    ("GARDENS", "GDNS", "GRDNS"),
    ("GATEWAY", "GTWY", "GTWAY GATWY GATEWY"),
    ("GLEN", "GLN", ""),
    ("GLENS", "GLNS", ""),
    ("GREEN", "GRN", ""),
    ("GREENS", "GRNS", ""),
    ("GROVE", "GRV", "GROV"),
    ("GROVES", "GRVS", ""),
    ("HARBOR", "HBR", "HARB HRBOR HARBR"),
    ("HARBORS", "HBRS", ""),
    ("HAVEN", "HVN", ""),
    ("HEIGHTS", "HTS", "HT"),
    ("HIGHWAY", "HWY", "HWAY HIWY HIWAY HIGHWY"),
    ("HILL", "HL", ""),
    ("HILLS", "HLS", ""),
    ("HOLLOW", "HOLW", "HLLW HOLLOWS HOLWS"),
    ("INLET", "INLT", ""),
    ("ISLAND", "IS", "ISLND"),
    ("ISLANDS", "ISS", "ISLNDS"),
    ("ISLE", "ISLE", "ISLES"),
    ("JUNCTION", "JCT", "JCTN JCTION JUNCTN JUNCTON"),
    ("JUNCTIONS", "JCTS", "JCTNS"),
    ("KEY", "KY", ""),
    ("KEYS", "KYS", ""),
    ("KNOLL", "KNL", "KNOL"),
    ("KNOLLS", "KNLS", ""),
    ("LAKE", "LK", ""),
    ("LAKES", "LKS", ""),
    ("LAND", "LAND", ""),
    ("LANDING", "LNDG", "LNDNG"),
    ("LANE", "LN", ""),
    ("LIGHT", "LGT", ""),
    ("LIGHTS", "LGTS", ""),
    ("LOAF", "LF", ""),
    ("LOCK", "LCK", ""),
    ("LOCKS", "LCKS", ""),
    ("LODGE", "LDG", "LDGE LODG"),
    ("LOOP", "LOOP", "LOOPS"),
    ("MALL", "MALL", ""),
    ("MANOR", "MNR", ""),
    ("MANORS", "MNRS", ""),
    ("MEADOW", "MDW", ""),
    ("MEADOWS", "MDWS", "MEDOWS"),
    ("MEWS", "MEWS", ""),
    ("MILL", "ML", ""),
    ("MILLS", "MLS", ""),
    ("MISSION", "MSN", "MISSN MSSN"),
    ("MOTORWAY", "MTWY", ""),
    ("MOUNT", "MT", "MNT"),
    ("MOUNTAIN", "MTN", "MNTN MTIN MNTAIN MOUNTIN"),
    ("MOUNTAINS", "MTNS", "MNTNS"),
    ("NECK", "NCK", ""),
    ("ORCHARD", "ORCH", "ORCHRD"),
    ("OVAL", "OVAL", "OVL"),
    ("OVERPASS", "OPAS", "OVERPAS"),
    ("PARK", "PARK", "PRK"),
    ("PARKS", "PARKS", ""),
    ("PARKWAY", "PKWY", "PKY PARKWY PKWAY"),
    ("PARKWAYS", "PKWYS", ""),
    ("PASS", "PASS", ""),
    ("PASSAGE", "PSGE", ""),
    ("PATH", "PATH", "PATHS"),
    ("PIKE", "PIKE", "PIKES"),
    ("PINE", "PNE", ""),
    ("PINES", "PNES", ""),
    ("PLACE", "PL", ""),
    ("PLAIN", "PLN", ""),
    ("PLAINS", "PLNS", ""),
    ("PLAZA", "PLZ", "PLZA"),
    ("POINT", "PT", ""),
    ("POINTS", "PTS", ""),
    ("PORT", "PRT", ""),
    ("PORTS", "PRTS", ""),
    ("PRAIRIE", "PR", "PRR PRAIRE"),
    ("RADIAL", "RADL", "RAD RADIEL"),
    ("RAMP", "RAMP", ""),
    ("RANCH", "RNCH", "RNCHS RANCHES"),
    ("RAPID", "RPD", ""),
    ("RAPIDS", "RPDS", ""),
    ("REST", "RST", ""),
    ("RIDGE", "RDG", "RDGE"),
    ("RIDGES", "RDGS", ""),
    ("RIVER", "RIV", "RVR RIVR"),
    ("ROAD", "RD", ""),
    ("ROADS", "RDS", ""),
    ("ROUTE", "RTE", ""),
    ("ROW", "ROW", ""),
    ("RUE", "RUE", ""),
    ("RUN", "RUN", ""),
    ("SHOAL", "SHL", ""),
    ("SHOALS", "SHLS", ""),
    ("SHORE", "SHR", "SHOAR"),
    ("SHORES", "SHRS", "SHOARS"),
    ("SKYWAY", "SKWY", ""),
    ("SPRING", "SPG", "SPNG SPRNG"),
    ("SPRINGS", "SPGS", "SPNGS SPRNGS"),
    ("SPUR", "SPUR", "SPURS"),
    ("SQUARE", "SQ", "SQR SQRE SQU"),
    ("SQUARES", "SQS", "SQRS"),
    ("STATION", "STA", "STN STATN"),
    ("STRAVENUE", "STRA", "STRAV STRAVN STRVN STRVNUE STRAVEN"),
    ("STREAM", "STRM", "STREME"),
    ("STREET", "ST", "STR STRT"),
    ("STREETS", "STS", ""),
    ("SUMMIT", "SMT", "SUMIT SUMITT"),
    ("TERRACE", "TERR", "TER"),
    ("THROUGHWAY", "TRWY", ""),
    ("TRACE", "TRCE", "TRACES"),
    ("TRACK", "TRAK", "TRK TRKS TRACKS"),
    ("TRAFFICWAY", "TRFY", ""),
    ("TRAIL", "TRL", "TRLS TRAILS"),
    ("TRAILER", "TRLR", "TRLRS"),
    ("TUNNEL", "TUNL", "TUNNL TUNLS TUNEL TUNNELS"),
    ("TURNPIKE", "TPKE", "TRNPK TURNPK"),
    ("UNDERPASS", "UPAS", ""),
    ("UNION", "UN", ""),
    ("UNIONS", "UNS", ""),
    ("VALLEY", "VLY", "VLLY VALLY"),
    ("VALLEYS", "VLYS", ""),
    ("VIADUCT", "VIA", "VDCT VIADCT"),
    ("VIEW", "VW", ""),
    ("VIEWS", "VWS", ""),
    ("VILLAGE", "VLG", "VILL VILLG VILLAG VILLIAGE"),
    ("VILLAGES", "VLGS", ""),
    ("VILLE", "VL", ""),
    ("VISTA", "VIS", "VIST VST VSTA"),
    ("WALK", "WALK", "WALKS"),
    ("WALL", "WALL", ""),
    ("WAY", "WAY", "WY"),
    ("WAYS", "WAYS", ""),
    ("WELL", "WL", ""),
    ("WELLS", "WLS", ""),
]

# Regions with their short form, primary name, whether it may be part of a street's name, country, and
# all spellings that are recognised beside the short form.
REGIONS = [
    ("AL", "ALABAMA", True, "US", ["ALABAMA"]),
    ("AK", "ALASKA", True, "US", ["ALASKA"]),
    ("AS", "AMERICAN SAMOA", False, "US", ["AMERICAN SAMOA"]),
    ("AZ", "ARIZONA", True, "US", ["ARIZONA"]),
    ("AR", "ARKANSAS", True, "US", ["ARKANSAS"]),
    ("CA", "CALIFORNIA", True, "US", ["CALIFORNIA"]),
    ("CO", "COLORADO", True, "US", ["COLORADO"]),
    ("CT", "CONNECTICUT", True, "US", ["CONNECTICUT", "CONN"]),
    ("DE", "DELAWARE", True, "US", ["DELAWARE", "DELEWARE"]),
    ("DC", "DISTRICT OF COLUMBIA", True, "US", ["DISTRICT OF COLUMBIA"]),
    ("FM", "FEDERATED STATES OF MICRONESIA", False, "US", ["FEDERATED STATES OF MICRONESIA", "MICRONESIA"]),
    ("FL", "FLORIDA", True, "US", ["FLORIDA"]),
    ("GA", "GEORGIA", True, "US", ["GEORGIA"]),
    ("GU", "GUAM", True, "US", ["GUAM"]),
    ("HI", "HAWAII", True, "US", ["HAWAII"]),
    ("ID", "IDAHO", True, "US", ["IDAHO"]),
    ("IL", "ILLINOIS", True, "US", ["ILLINOIS"]),
    ("IN", "INDIANA", True, "US", ["INDIANA"]),
    ("IA", "IOWA", True, "US", ["IOWA"]),
    ("KS", "KANSAS", True, "US", ["KANSAS"]),
    ("KY", "KENTUCKY", True, "US", ["KENTUCKY"]),
    ("LA", "LOUISIANA", True, "US", ["LOUISIANA"]),
    ("ME", "MAINE", True, "US", ["MAINE"]),
    ("MH", "MARSHALL ISLANDS", True, "US", ["MARSHALL ISLANDS", "MARSHALL IS", "MARSHALL ISL", "MARSHALL ISLS", "MARSHALL ISS", "MARSHALL ISLD"]),
    ("MD", "MARYLAND", True, "US", ["MARYLAND"]),
    ("MA", "MASSACHUSETTS", True, "US", ["MASSACHUSETTS", "MASS"]),
    ("MI", "MICHIGAN", True, "US", ["MICHIGAN"]),
    ("MN", "MINNESOTA", True, "US", ["MINNESOTA", "MINN"]),
    ("MS", "MISSISSIPPI", True, "US", ["MISSISSIPPI"]),
    ("MO", "MISSOURI", True, "US", ["MISSOURI"]),
    ("MT", "MONTANA", True, "US", ["MONTANA"]),
    ("NE", "NEBRASKA", True, "US", ["NEBRASKA"]),
    ("NV", "NEVADA", True, "US", ["NEVADA"]),
    ("NH", "NEW HAMPSHIRE", True, "US", ["NEW HAMPSHIRE"]),
    ("NJ", "NEW JERSEY", True, "US", ["NEW JERSEY"]),
    ("NM", "NEW MEXICO", True, "US", ["NEW MEXICO"]),
    ("NY", "NEW YORK", True, "US", ["NEW YORK"]),
    ("NC", "NORTH CAROLINA", True, "US", ["NORTH CAROLINA", "N CAROLINA"]),
    ("ND", "NORTH DAKOTA", True, "US", ["NORTH DAKOTA", "N DAKOTA"]),
    ("MP", "NORTHERN MARIANA ISLANDS", True, "US", ["NORTHERN MARIANA ISLANDS", "NORTHERN MARIANA IS", "NORTHERN MARIANA ISL", "NORTHERN MARIANA ISLS", "NORTHERN MARIANA ISS", "NORTHERN MARIANA ISLD", "N MARIANA ISLANDS", "N MARIANA IS", "N MARIANA ISL", "N MARIANA ISLS", "N MARIANA ISS", "N MARIANA ISLD"]),
    ("OH", "OHIO", True, "US", ["OHIO"]),
    ("OK", "OKLAHOMA", True, "US", ["OKLAHOMA"]),
    ("OR", "OREGON", True, "US", ["OREGON"]),
    ("PW", "PALAU", True, "US", ["PALAU"]),
    ("PA", "PENNSYLVANIA", True, "US", ["PENNSYLVANIA", "PENN"]),
    ("PR", "PUERTO RICO", True, "US", ["PUERTO RICO"]),
    ("RI", "RHODE ISLAND", True, "US", ["RHODE ISLAND", "RHODE IS", "RHODE ISL", "RHODE ISLD"]),
    ("SC", "SOUTH CAROLINA", True, "US", ["SOUTH CAROLINA", "S CAROLINA"]),
    ("SD", "SOUTH DAKOTA", True, "US", ["SOUTH DAKOTA", "S DAKOTA"]),
    ("TN", "TENNESSEE", True, "US", ["TENNESSEE", "TENN"]),
    ("TX", "TEXAS", True, "US", ["TEXAS"]),
    ("UT", "UTAH", True, "US", ["UTAH"]),
    ("VT", "VERMONT", True, "US", ["VERMONT"]),
    ("VI", "VIRGIN ISLANDS", True, "US", ["VIRGIN ISLANDS", "USVI", "VIS", "USA VI", "VI USA", "VIRGIN IS", "VIRGIN ISL", "VIRGIN ISLS", "VIRGIN ISS", "VIRGIN ISLD", "US VIRGIN ISLANDS", "US VIRGIN IS", "US VIRGIN ISL", "US VIRGIN ISLS", "US VIRGIN ISS", "US VIRGIN ISLD"]),
    ("VA", "VIRGINIA", True, "US", ["VIRGINIA"]),
    ("WA", "WASHINGTON", True, "US", ["WASHINGTON"]),
    ("WV", "WEST VIRGINIA", True, "US", ["WEST VIRGINIA", "W VIRGINIA"]),
    ("WI", "WISCONSIN", True, "US", ["WISCONSIN"]),
    ("WY", "WYOMING", True, "US", ["WYOMING"]),
    ("AB", "ALBERTA", True, "Canada", ["ALBERTA"]),
    ("BC", "BRITISH COLUMBIA", True, "Canada", ["BRITISH COLUMBIA"]),
    ("MB", "MANITOBA", True, "Canada", ["MANITOBA"]),
    ("NB", "NEW BRUNSWICK", True, "Canada", ["NEW BRUNSWICK"]),
    ("NL", "NEWFOUNDLAND AND LABRADOR", False, "Canada", ["NEWFOUNDLAND AND LABRADOR", "NEWFOUNDLAND", "LABRADOR"]),
    ("NT", "NORTHWEST TERRITORIES", False, "Canada", ["NORTHWEST TERRITORIES", "NORTHWEST TERR", "NW TERRITORIES", "NW TERR"]),
    ("NS", "NOVA SCOTIA", True, "Canada", ["NOVA SCOTIA"]),
    ("NU", "NUNAVAT TERRITORIES", False, "Canada", ["NUNAVAT TERRITORY", "NUNAVAT TERR"]),
    ("ON", "ONTARIO", True, "Canada", ["ONTARIO"]),
    ("PE", "PRINCE EDWARD ISLAND", False, "Canada", ["PRINCE EDWARD ISLAND", "PRINCE EDWARD IS", "PRINCE EDWARD ISL", "PRINCE EDWARD ISLD"]),
    ("QC", "QUEBEC", True, "Canada", ["QUEBEC"]),
    ("SK", "SASKATCHEWAN", True, "Canada", ["SASKATCHEWAN"]),
    ("YT", "YUKON TERRITORY", True, "Canada", ["YUKON TERRITORY", "YUKON TERR", "YUKON"]),
    ("AE", "ARMED FORCES EUROPE THE MIDDLE EAST AND CANADA", False, "overseas", ["ARMED FORCES EUROPE THE MIDDLE EAST AND CANADA", "ARMED FORCES EUROPE"]),
    ("AP", "ARMED FORCES PACIFIC", False, "overseas", ["ARMED FORCES PACIFIC"]),
    ("AA", "ARMED FORCES AMERICA", False, "overseas", ["ARMED FORCES AMERICA", "ARMED FORCES AMERICAS"]),
]

# Secondary units with their short form and whether they take a number.
UNITS = [
    ("APARTMENT", "APT", True),
    ("BASEMENT", "BSMT", False),
    ("BUILDING", "BLDG", True),
    ("DEPARTMENT", "DEPT", True),
    ("FLOOR", "FL", True),
    ("FRONT", "FRNT", False),
    ("HANGER", "HNGR", True),
    ("KEY", "KEY", True),
    ("LOBBY", "LBBY", False),
    ("LOT", "LOT", True),
    ("LOWER", "LOWR", False),
    ("OFFICE", "OFC", False),
    ("PENTHOUSE", "PH", False),
    ("PIER", "PIER", True),
    ("REAR", "REAR", False),
    ("ROOM", "RM", True),
    ("SIDE", "SIDE", False),
    ("SLIP", "SLIP", True),
    ("SPACE", "SPC", True),
    ("STOP", "STOP", True),
    ("SUITE", "STE", True),
    ("TRAILER", "TRLR", True),
    ("UNIT", "UNIT", True),
    ("UPPER", "UPPR", False),
]

# Directions, countries, Puerto Rican street types and secondary designators, military designators, post
# office box designators in order of precedence.
DIRECTIONS = {"NORTH": "N", "EAST": "E", "SOUTH": "S", "WEST": "W", "NORTHEAST": "NE", "SOUTHEAST": "SE", "NORTHWEST": "NW", "SOUTHWEST": "SW"}
COUNTRIES = {"UNITED STATES": "", "USA": "", "US": "", "CA": "CANADA", "CANADA": "CANADA", "MX": "MEXICO", "MEXICO": "MEXICO"}
PR_STREET_TYPES = {"AVENIDA": "AVE", "CALLE": "CLL", "CAMINITO": "CMT", "CAMINO": "CAM", "CERRADA": "CER", "CIRCULO": "CIR", "ENTRADA": "ENT", "PASEO": "PSO", "PLACITA": "PLA", "RANCHO": "RCH", "VEREDA": "VER", "VISTA": "VIS"}
PR_SECONDARY = {
    "APARTAMENTO": "APT", "BARRIADA": "BDA", "BUILDING": "BLDG", "BLOQUE": "BL", "BARRIO": "BO", "CARRETERA": "CARR", "CASERIO": "CAS", "CONDOMINIO": "COND", "COOPERATIVA": "COOP", "CORPORACION": "CORP", "DEPARTAMENTO": "DEPT", "EDIFICIO": "EDIF", "ENTREGA GENERAL": "GEN DEL", "EXTENCION": "EXT",
    "HOSPITAL": "HOSP", "INDUSTRIAL": "IND", "JARDINES": "JARD", "MANSIONES": "MANS", "PARCELAS": "PARC", "QUEBRADA": "QBDA", "REPARTO": "REPTO", "RESIDENCIAL": "RES", "SECTOR": "SEC", "TERRAZA": "TERR", "URBANIZATION": "URB", "URBANIZACION": "URB", "VILLA": "VIL",
}
PR_ZIP_PREFIXES = ("006", "007", "009")
MILITARY_STREETS = ("CMR", "OMC", "PSC", "UMR", "UNIT")
MILITARY_CITIES = ("APO", "FPO", "DPO")
MILITARY_REGIONS = ("AE", "AP", "AA")
BOX_DESIGNATORS = ("POST OFFICE BOX", "PO BOX", "POB", "FIRM CALLER", "CALLER", "BIN", "LOCKBOX", "DRAWER")
BOX_RESERVED = ("POST OFFICE BOX", "PO BOX", "POB")
RURAL_DESIGNATORS = ("RURAL ROUTE", "RFD ROUTE", "RFD", "RR", "RD")


def suffixes() -> dict[str, tuple[str, str]]:
    """Spelling to (primary, short): further spellings, then primary names, then short forms; later ones win."""
    out = {x: (primary, short) for primary, short, more in SUFFIXES for x in more.split()}
    out |= {primary: (primary, short) for primary, short, _ in SUFFIXES}
    return out | {short: (primary, short) for primary, short, _ in SUFFIXES}


def regions() -> dict[str, tuple[str, str, bool]]:
    """Spelling to (primary, short, may be a street name)."""
    return {k: (primary, short, street) for short, primary, street, _, spellings in REGIONS for k in [short, *spellings]}


def spellings_of(table: dict) -> dict:
    """Entry to all spellings that lead to it, in order."""
    out: dict = {}
    for k, entry in table.items():
        out.setdefault(entry, []).append(k)
    return {entry: sorted(ks) for entry, ks in out.items()}


def units() -> dict[str, tuple[str, bool]]:
    """Spelling to (short, takes a number)."""
    return {"#": ("#", True)} | {k: (short, numbered) for primary, short, numbered in UNITS for k in (primary, short)}


def directions_short() -> dict[str, str]:
    return DIRECTIONS | {s: s for s in DIRECTIONS.values()}


def directions_full() -> dict[str, str]:
    return {d: d for d in DIRECTIONS} | {s: d for d, s in DIRECTIONS.items()}


def state_prefixes() -> dict[str, str]:
    """Names and codes that may open a highway's name, to codes: states and possessions, but not FM (farm to market)."""
    domestic = [(short, primary) for short, primary, _, country, _ in REGIONS if country == "US"]
    out = {primary: short for short, primary in domestic} | {short: short for short, _ in domestic if short != "FM"}
    return out | {"MICRONESIA": "FM"}
