"""Reviewed word lists, lookup tables and constants the checks are defined by."""

from __future__ import annotations

# --- fixed values: claim registry -------------------------------------------------
CLAIM_STATUSES = ("official", "derived", "estimated", "unverified")
CLAIM_SEVERITIES = ("critical", "medium", "minor")
PARITY_STATUSES = ("official", "derived")
STALE_AFTER_DAYS = {"critical": 45, "medium": 90, "minor": 90}
OFFICIAL_DOMAINS = {
    "NZ": ("immigration.govt.nz", "employment.govt.nz", "ird.govt.nz"),
    "CA": (
        "canada.ca", "ircc.canada.ca", "ontario.ca", "gov.bc.ca",
        "alberta.ca", "jobbank.gc.ca", "welcomebc.ca",
    ),
    "AU": ("immi.homeaffairs.gov.au", "ato.gov.au", "fairwork.gov.au"),
}
COMMON_DOMAINS = ("oecd.org", "worldbank.org", "ilo.org", "un.org")
CLAIM_REQUIRED = (
    "id", "country", "locale", "category", "label", "value", "status",
    "verifiedAt", "sourceUrl", "pages", "severity",
)
CLAIM_REQUIRED_TEXT = (
    "id", "country", "locale", "category", "label", "status",
    "verifiedAt", "sourceUrl", "severity",
)
CLAIM_OPTIONAL_TEXT = (
    "unit", "effectiveFrom", "effectiveTo", "currentAsOf",
    "effectiveFromUnknownReason", "parityKey", "notes", "parityExemptReason",
)

# --- fixed values: employer directory ----------------------------------------------
COUNTRIES = ("NZ", "AU")
PRECISIONS = ("exact", "postcode", "town", "region")
SOURCE_KINDS = (
    "government-register", "government-job-gateway", "industry-association",
    "employer-official", "verified-local-producer", "unverified",
)
CONTACT_KINDS = ("recruitment", "company", "email", "none")
DIRECTORY_STATUSES = ("active", "uncertain", "expired")
VACANCY_STATUSES = ("directory-only",)
WORK_TYPES = (
    "construction", "farm-packing", "farm-processing", "food-processing",
    "grain-processing", "horticulture", "job-gateway", "labour-contracting",
    "livestock-processing", "meat-processing", "mining", "nursery",
    "orchard-contracting", "packhouse", "packhouse-orchard",
    "packhouse-processing", "quality-lab", "viticulture-contracting",
    "viticulture-winery", "winery-processing",
)
ENTRY_KEYS = (
    "id", "country", "name", "location", "workTypes", "source", "contact",
    "status", "nextReviewAt", "vacancyStatus", "eligibility",
)
LOCATION_KEYS = ("label", "region", "lat", "lng", "precision")
LOCATION_OPTIONAL_KEYS = ("address", "state", "postcode")
SOURCE_KEYS, SOURCE_OPTIONAL_KEYS = ("kind", "url", "checkedAt"), ("effectiveTo",)
CONTACT_KEYS, CONTACT_OPTIONAL_KEYS = ("kind",), ("url",)
ELIGIBILITY_KEYS = ("scheme", "classification", "requiresRoleCheck", "requiresLocationCheck")
ELIGIBILITY_BY_COUNTRY = {
    "NZ": ("nz-whv-extension", "conditional", True, False),
    "AU": ("au-417-specified-work", "conditional", True, True),
}
POSTCODE_RANGES = {
    "ACT": ((200, 299), (2600, 2618), (2900, 2920)),
    "NSW": ((1000, 2599), (2619, 2899), (2921, 2999)),
    "NT": ((800, 899), (900, 999)),
    "QLD": ((4000, 4999), (9000, 9999)),
    "SA": ((5000, 5799), (5800, 5999)),
    "TAS": ((7000, 7799), (7800, 7999)),
    "VIC": ((3000, 3999), (8000, 8999)),
    "WA": ((6000, 6797), (6800, 6999)),
}
# (min lat, max lat, min lng, max lng)
BOUNDING_BOXES = {
    "NZ": (-47.5, -33.0, 165.0, 179.5),
    "AU": (-44.5, -10.0, 112.0, 154.5),
}
INDUSTRY_HOSTS = ("ausveg.com.au", "nzkgi.org.nz", "freshproduce.org.au", "ntfarmers.org.au")
GOVERNMENT_SUFFIX = {"NZ": "govt.nz", "AU": "gov.au"}
PUBLIC_SUFFIXES = ("govt.nz", "co.nz", "org.nz", "gov.au", "com.au", "org.au", "net.au")
ID_PATTERN = r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*"
VACANCY_PATTERN = (
    r"(?i)\b(?:currently hiring|hiring now|vacanc(?:y|ies)(?: available| open)?|"
    r"jobs? available|apply now|open positions?)\b"
)
MAILTO_PATTERN = (
    r"mailto:[A-Za-z0-9.!#$%&'*+/=^_`{|}~-]+@"
    r"[A-Za-z0-9](?:[A-Za-z0-9.-]{0,251}[A-Za-z0-9])?"
)
RECRUITMENT_PATTERN = r"(?i)career|job|work-with|employment|opportunit|recruit"
LEGACY_WORK_TYPES = {
    "농장/원예": "horticulture",
    "과수원/계약": "orchard-contracting",
    "인력/계약": "labour-contracting",
    "종묘/육묘": "nursery",
    "팩하우스": "packhouse",
    "팩하우스/과수원": "packhouse-orchard",
    "포도/계약": "viticulture-contracting",
    "포도/와이너리": "viticulture-winery",
    "품질/검사": "quality-lab",
    "건설/현장": "construction",
    "곡물/가공": "grain-processing",
    "광업": "mining",
    "구직지원": "job-gateway",
    "농장/가공": "farm-processing",
    "농장/팩킹": "farm-packing",
    "식품가공": "food-processing",
    "와이너리/가공": "winery-processing",
    "와이너리/포도": "viticulture-winery",
    "축산/가공": "livestock-processing",
    "축산/육가공": "meat-processing",
    "팩하우스/가공": "packhouse-processing",
}
REGION_CENTRES = (
    ("Northland", -35.2284, 173.9470),
    ("Auckland", -37.2012, 174.9010),
    ("Waikato", -37.8911, 175.4690),
    ("Bay of Plenty", -37.7833, 176.3250),
    ("Gisborne", -38.6623, 178.0176),
    ("Hawke's Bay", -39.6381, 176.8492),
    ("Manawatū-Whanganui", -40.6223, 175.2865),
    ("Wellington / Wairarapa", -41.2189, 175.4597),
    ("Marlborough", -41.5134, 173.9612),
    ("Nelson / Tasman", -41.1080, 173.0110),
    ("Canterbury", -43.9036, 171.7480),
    ("Otago", -45.0384, 169.2007),
)
TOWN_OR_REGION_NZ = r"(?i)Bay of Plenty|Western Bay|region|district|[·/]"
TOWN_OR_REGION_AU = r"(?i)/|district|region|projects|area|전국|basin|goldfields|pilbara|tablelands|valley"

# --- fixed values: numeric facts in page text ---------------------------------------
SEMANTIC_TAGS = ("p", "li", "tr", "label", "summary", "h1", "h2", "h3", "h4", "h5", "h6")
IGNORED_TAGS = ("style", "script", "svg", "template", "noscript")
SUPPRESSED_TAGS = ("script", "style", "template", "noscript")
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input",
    "link", "meta", "param", "source", "track", "wbr",
)
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
HIDDEN_STYLES = ("display:none", "visibility:hidden")
HIDDEN_ID_PREFIX = "History_"
SIMPLE_ID = r"[A-Za-z_][A-Za-z0-9_-]*"
QUOTED_IN_SELECTOR = r'["\\]'
IGNORED_CONTEXT = r"(?i)(?:scenario|changeline|flight|calendar|season(?:al)?-map|city-map|diagnose)"
VISA_IDENTIFIERS = ("186", "189", "190", "191", "417", "462", "482", "485", "491", "500", "820")
NUMBER_TOKEN = (
    r"(?<![A-Za-z0-9_])(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?:[kKmM]\b)?(?![A-Za-z0-9_])"
)
DATE_SPAN = r"\b20\d{2}[-/]\d{1,2}(?:[-/]\d{1,2})?\b|\b\d{1,2}\s*월\s*\d{1,2}\s*일\b"
CLAUSE_BREAK = r"'\s*,\s*'|\s+[—–]\s+|[·;+。!?]|\.(?=\s)"
TIME_UNIT = (
    r"(?i)(?:년|개월|주|일|시간|歳|年|ヶ月|か月|週間|日|時間|"
    r"years?|months?|weeks?|days?|hours?)"
)
IMMIGRATION_WORDS = (
    r"(?i)(?:비자|영주권|체류|visa|permit|residen|WHV|IEC|AEWV|PGWP|SMC|"
    r"ビザ|永住|滞在)"
)
CATEGORY_PATTERNS = {
    "fee": r"(?i)(?:신청비|수수료|비자비|fee(?:s)?|application cost|申請費|手数料|料金)",
    "age": r"(?i)(?:연령|나이|age\b|\d[\d\s–~〜～-]*세\b|\d[\d\s–~〜～-]*歳)",
    "quota": r"(?i)(?:쿼터|정원|선발권|quota|定員|枠)",
    "wage": (
        r"(?i)(?:최저임금|중위임금|시급|연봉|급여|minimum wage|median wage|"
        r"hourly wage|salary|最低賃金|中央値賃金|時給|年収|給与)"
    ),
    "tax": r"(?i)(?:세율|소득세|원천징수|tax(?: rate)?|income tax|税率|所得税)",
    "funds": (
        r"(?i)(?:자금증명|생활비 증명|proof of funds|financial support|"
        r"settlement funds|資金証明|生活費証明)"
    ),
    "processing": r"(?i)(?:처리(?:기간)?|processing(?: time)?|処理(?:期間)?)",
    "duration": (
        r"(?i)(?:체류기간|유효기간|근무기간|기간|만료|stay|duration|valid for|"
        r"滞在期間|有効期間|勤務期間|期間)"
    ),
}
# the words of CATEGORY_PATTERNS in lower case; a pattern adds what words alone don't say
CATEGORY_WORDS = {
    "fee": ("신청비", "수수료", "비자비", "fee", "application cost", "申請費", "手数料", "料金"),
    "age": ("연령", "나이"),
    "quota": ("쿼터", "정원", "선발권", "quota", "定員", "枠"),
    "wage": (
        "최저임금", "중위임금", "시급", "연봉", "급여", "minimum wage", "median wage",
        "hourly wage", "salary", "最低賃金", "中央値賃金", "時給", "年収", "給与",
    ),
    "tax": ("세율", "소득세", "원천징수", "tax", "税率", "所得税"),
    "funds": (
        "자금증명", "생활비 증명", "proof of funds", "financial support",
        "settlement funds", "資金証明", "生活費証明",
    ),
    "processing": ("처리", "processing", "処理"),
    "duration": (
        "체류기간", "유효기간", "근무기간", "기간", "만료", "stay", "duration", "valid for",
        "滞在期間", "有効期間", "勤務期間", "期間",
    ),
}
# words that a pattern goes on from: (words, pattern)
CATEGORY_FORMS = {"age": (("age", "세", "歳"), r"(?i)(?:age\b|\d[\d\s–~〜～-]*(?:세\b|歳))")}
CURRENCY_WORDS = ("nzd", "cad", "aud", "$")
CATEGORY_BY_ID = {
    "fee": r"(?:^|-)(?:fee|fees|ivl)(?:-|$)",
    "age": r"(?:^|-)age(?:-|$)",
    "quota": r"(?:^|-)(?:quota|cap)(?:-|$)",
    "wage": r"(?:^|-)(?:wage|median|csit|ssit)(?:-|$)",
    "tax": r"(?:^|-)(?:tax|netpay|acc)(?:-|$)",
    "funds": r"(?:^|-)funds?(?:-|$)",
    "processing": r"(?:^|-)(?:processing|service-standard)(?:-|$)",
    "duration": (
        r"(?:^|-)(?:duration|second-work|third-work|overstay|reentry-ban|pr-eligibility)(?:-|$)"
    ),
}

# --- fixed values: responses and trend -----------------------------------------------
REQUEST_STATUSES = ("ready", "transient", "blocked", "changed", "unsupported")
HTML_MEDIA = ("text/html", "application/xhtml+xml")
PDF_MEDIA = ("application/pdf",)
JSON_MEDIA = ("application/json", "application/problem+json")
CSV_MEDIA = ("text/csv", "application/csv")
XML_MEDIA = ("application/xml", "text/xml", "application/xhtml+xml")
MAX_TREND_EVENTS = 8
MAX_POINTER_DEPTH = 24
BOUNDARY_KINDS = ("rate", "insurance", "age", "duration")

# --- fixed values: reviewed rate constants ---------------------------------------------
NZ_RATES = {
    "brackets": ((15600, 0.105), (53500, 0.175), (78100, 0.30), (180000, 0.33), (None, 0.39)),
    "levy": {"rate": 0.0175, "cap": 156641},
}
CA_RATES = {
    "federal": {
        "brackets": ((58523, 0.14), (117045, 0.205), (181440, 0.26), (258482, 0.29), (None, 0.33)),
        "personal": 16452,
        "employment": 1501,
        "credit_rate": 0.14,
    },
    "provinces": {
        "on": {
            "brackets": ((53891, 0.0505), (107785, 0.0915), (150000, 0.1116), (220000, 0.1216), (None, 0.1316)),
            "personal": 12989,
        },
        "bc": {
            "brackets": (
                (50363, 0.056), (100728, 0.077), (115648, 0.105), (140430, 0.1229),
                (190405, 0.147), (265545, 0.168), (None, 0.205),
            ),
            "personal": 13216,
        },
        "ab": {
            "brackets": (
                (61200, 0.08), (154259, 0.10), (185111, 0.12), (246813, 0.13), (370220, 0.14), (None, 0.15),
            ),
            "personal": 22769,
        },
    },
    "pension": {
        "rate": 0.0595, "base": 0.0495, "additional": 0.01, "ceiling": 74600, "exempt": 3500,
        "second_rate": 0.04, "second_min": 74600, "second_max": 85000,
    },
    "insurance": {"rate": 0.0163, "max": 68900},
    "ontario": {
        "surtax_lower": 5818, "surtax_upper": 7446, "surtax_lower_rate": 0.20, "surtax_upper_rate": 0.36,
        "reduction": 600,
        "health_zero_to": 20000,
        # (to, base, offset, rate, cap); the last tier is open
        "health_tiers": (
            (36000, 0, 20000, 0.06, 300),
            (48000, 300, 36000, 0.06, 450),
            (72000, 450, 48000, 0.25, 600),
            (200000, 600, 72000, 0.25, 750),
            (None, 750, 200000, 0.25, 900),
        ),
    },
}
AU_RATES = {
    "holiday": {"cap": 45000, "rate": 0.15},
    "brackets": ((18200, 0.0), (45000, 0.15), (135000, 0.30), (190000, 0.37), (None, 0.45)),
    "medicare": 0.02,
    "super": 0.12,
    "offset": {
        "max": 700, "full_to": 37500, "taper1_to": 45000, "taper1_rate": 0.05,
        "cut_out": 66667, "taper2_rate": 0.015,
    },
}
