"""Label orders, code maps, band edges and rule tables.

These must equal the values the original reports use for results to agree; they are data, kept
together here in their natural order.
"""

# --- fixed values: label orders -------------------------------------------------------------
EXPERIENCE_LEVELS = ["Entry level", "Associate", "Mid-Senior level", "Director", "Executive"]
EXPERIENCE_LEVELS_ALL = EXPERIENCE_LEVELS + ["Internship", "Unknown"]
WORK_TYPES_MAIN = ["Full-time", "Contract", "Part-time"]
SIZE_LABELS = {1: "1-10", 2: "11-50", 3: "51-200", 4: "201-500",
               5: "501-1K", 6: "1K-5K", 7: "5K-10K", 8: "10K+"}
SIZE_ORDER = list(SIZE_LABELS.values())
REMOTE_LABELS = {1: "Remote", 0: "Office/Hybrid"}
NEXT_LEVEL = {"Entry level": "Associate", "Associate": "Mid-Senior level",
              "Mid-Senior level": "Director", "Director": "Executive", "Executive": "Executive"}

# --- fixed values: salary bands (edges are (lo, hi]; None = open) ------------------------------
SALARY_BANDS_REPORT = ([0, 40_000, 70_000, 100_000, 140_000, 200_000, None],
                       ["<$40K", "$40K-70K", "$70K-100K", "$100K-140K", "$140K-200K", "$200K+"])
SALARY_BANDS_MODEL = ([0, 50_000, 75_000, 100_000, 130_000, 160_000, 200_000, 300_000],
                      ["<$50k", "$50k-75k", "$75k-100k", "$100k-130k", "$130k-160k",
                       "$160k-200k", "$200k+"])
BENEFIT_BUCKETS = ([-1, 0, 2, 4, 8, 100], ["0", "1-2", "3-4", "5-8", "9+"])

# --- fixed values: salary cleaning profiles (lo, hi) ------------------------------------------
SALARY_RANGE_REPORTS = (10_000, 1_000_000)
SALARY_RANGE_DASHBOARD = (10_000, 300_000)
GAP_RANGE = (10_000, 500_000)

# --- fixed values: title family rules of the dashboard, first match wins ----------------------
TITLE_FAMILY_RULES = [
    (r"product", "product"),
    (r"data|machine learning|ai|analyst|scientist", "data_ai"),
    (r"sales|account executive|business development|sdr", "sales"),
    (r"manager|director|chief|vp|head of|leadership", "management"),
    (r"software|engineer|developer|sre|backend|frontend|full stack|platform", "software_engineering"),
    (r"nurse|doctor|clinical|medical|pharmacy|therap", "healthcare"),
    (r"marketing|brand|seo|content|growth", "marketing"),
    (r"consultant|advisor|strategy", "consulting_analyst"),
    (r"finance|account|audit|controller|treasury", "finance"),
    (r"security|cyber|infosec", "cybersecurity"),
    (r"human resources|recruiter|talent|people", "hr_recruiting"),
]
TITLE_FAMILY_DEFAULT = "other"

# --- fixed values: high-value benefits for package strength -----------------------------------
HIGH_VALUE_BENEFITS = ["Medical insurance", "Dental insurance", "Vision insurance", "401(k)",
                       "Paid time off", "Parental leave", "Tuition assistance"]

# --- fixed values: text signals (the five fields the enrichment step asks for) ----------------
# word boundaries are spelled as ASCII classes so Java regex and RE2 agree on non-ASCII text
_B0, _B1 = r"(^|[^A-Za-z0-9_])", r"([^A-Za-z0-9_]|$)"
DEGREE_PATTERN = _B0 + r"(?i:bachelor|master|degree|ph\.?d)|" + _B0 + r"(BS|MS|B\.S\.|M\.S\.)" + _B1
SOFT_SKILL_RULES = [
    ("communication", r"(?i)communicat"),
    ("leadership", r"(?i)leadership|(^|[^A-Za-z])lead(ing)? (a |the )?team"),
    ("teamwork", r"(?i)teamwork|team player|collaborat"),
    ("analytical", r"(?i)analytical|problem[- ]solving|critical thinking"),
    ("other", r"(?i)interpersonal|adaptab|attention to detail|self-motivated|organi[sz]ational skills"),
]
URGENCY_HIGH = r"(?i)immediately|urgent|asap|a\.s\.a\.p"
URGENCY_LOW = r"(?i)no rush|flexible"
# a text that matches a pattern above holds one of its words in lower(text); the degree's letters in the text itself
DEGREE_WORDS, DEGREE_LETTERS = ["bachelor", "master", "degree", "phd", "ph.d"], ["BS", "MS", "B.S.", "M.S."]
SOFT_SKILL_WORDS = {
    "communication": ["communicat"],
    "leadership": ["leadership", "lead team", "lead a team", "lead the team", "leading team", "leading a team",
                   "leading the team"],
    "teamwork": ["teamwork", "team player", "collaborat"],
    "analytical": ["analytical", "problem-solving", "problem solving", "critical thinking"],
    "other": ["interpersonal", "adaptab", "attention to detail", "self-motivated", "organisational skills",
              "organizational skills"],
}
URGENCY_HIGH_WORDS, URGENCY_LOW_WORDS = ["immediately", "urgent", "asap", "a.s.a.p"], ["no rush", "flexible"]
TECH_ROLE_PATTERN = (r"(?i)programm|software|developer|data|engineer|machine learning|devops|"
                     r"cloud|python|java|sql")

# --- fixed values: title keyword flags of the salary model (pattern searched in lower(title)) --
TITLE_FLAGS = [
    ("title_senior", r"senior|sr\.?\b|lead|staff"),
    ("title_principal", r"principal"),
    ("title_director", r"director|head of"),
    ("title_vp", r"\bvp\b|vice pres"),
    ("title_chief", r"\bchief\b|president|ceo|cto|cfo|coo"),
    ("title_manager", r"manager|mgr"),
    ("title_junior", r"junior|jr\.?\b|entry|intern"),
    ("title_associate", r"\bassociate\b"),
    ("title_engineer", r"engineer|developer|software|swe|sde"),
    ("title_architect", r"architect"),
    ("title_data", r"data|analyst|scientist|ml|ai|machine"),
    ("title_sales", r"sales|account exec|business dev"),
    ("title_consultant", r"consultant|advisor"),
    ("title_nurse", r"nurse|rn\b|lpn"),
    ("title_product", r"product"),
    ("title_finance", r"finance|accountant|controller|accounting|auditor"),
    ("title_security", r"security|cyber|infosec"),
    ("title_marketing", r"marketing|brand|seo|content"),
    ("title_hr", r"human resources|recruiter|talent|people partner"),
]

# --- fixed values: title family rules of the salary model, first match wins ------------------
TITLE_FAMILY_RULES_MODEL = [
    (r"nurse|rn\b|lpn|medical assistant|physician|therapist|clinical", "healthcare"),
    (r"machine learning|data scientist|data engineer|data analyst|analytics|bi\b|ai\b|ml\b", "data_ai"),
    (r"software|engineer|developer|swe|sde|backend|frontend|full stack|devops|cloud|architect",
     "software_engineering"),
    (r"product manager|product owner|product lead", "product"),
    (r"sales|account executive|business development|customer success", "sales"),
    (r"marketing|brand|seo|content|growth", "marketing"),
    (r"finance|accountant|accounting|controller|auditor|tax", "finance"),
    (r"human resources|recruiter|talent|people partner", "hr_recruiting"),
    (r"security|cyber|infosec", "cybersecurity"),
    (r"manager|director|vp|vice president|chief|president|head of", "management"),
    (r"consultant|advisor|analyst", "consulting_analyst"),
]

# --- fixed values: experience imputation from the title, first match wins ---------------------
# compat form: plain substring tests (so 'director' contains 'cto'); default form adds word
# boundaries to the same words
EXPERIENCE_IMPUTE_RULES = [
    ("Executive", ["chief", "president", "ceo", "cto", "cfo", "coo"]),
    ("Director", ["vp", "vice pres", "director", "head of"]),
    ("Mid-Senior level", ["principal", "senior", "sr.", "lead", "staff", "manager"]),
    ("Entry level", ["junior", "jr.", "intern", "entry"]),
]
EXPERIENCE_IMPUTE_DEFAULT = "Mid-Senior level"

# --- fixed values: salary-text scrubbing ------------------------------------------------------
SALARY_SENTENCE_KEYWORDS = (r"(?i)salary\s*range|compensation\s*range|pay\s*range|base\s*salary|"
                            r"annual\s*salary|hourly\s*rate|expected\s*salary|pay\s*rate|"
                            r"bonus\s*eligible|compensation|salary")
DOLLAR_AMOUNT = (r"(?i)\$\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:k|K)?"
                 r"(?:\s*[-–—to]+\s*\$?\s?\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*(?:k|K)?)?")
HOURLY_RATE = (r"(?i)\b\d{1,3}(?:\.\d+)?(?:\s*[-–—]+\s*\d{1,3}(?:\.\d+)?)?"
               r"\s*(?:per\s*hour|/hour|/hr|hourly)\b")
CURRENCY_WORDS = r"(?i)\b(?:usd|dollars|per\s+year|yearly|annually)\b"
LIGHT_DOLLAR = r"\$\s?\d[\d,]*(?:\.\d+)?(?:\s?[kK])?"
LIGHT_AMOUNT_WORD = r"\b\d+[\d,]*(?:\.\d+)?\s?(?:USD|usd|dollars?)\b"
LIGHT_WORDS = (r"(?i)\b(?:salary range|compensation range|pay range|base salary|annual salary|"
               r"hourly rate|expected salary|salary|compensation|pay rate|bonus eligible|usd|"
               r"dollars|per year|yearly|annually)\b")

# --- fixed values: scenario and explanation rules of the salary estimator ---------------------
SCENARIO_SKILLS = ["Information Technology", "Project Management", "Analyst"]
SCENARIO_BENEFITS = ["Medical insurance", "401(k)", "Paid time off"]
SCENARIO_CAP = 8
HIGH_PAY_STATES = ["CA", "NY", "WA", "MA"]
LARGE_SIZES = ["1K-5K", "5K-10K", "10K+"]
SENIOR_TITLE = r"senior|principal|staff|lead|director|vp|chief"
TECH_TITLE = r"software|engineer|data|machine learning|ai|security|cloud"

# --- fixed values: metro names of the salary model's location rules (first match wins) ---------
CITY_METRO_MAP = [
    ("new york city metropolitan area", "New York"),
    ("greater new york city area", "New York"),
    ("san francisco bay area", "San Francisco"),
    ("greater seattle area", "Seattle"),
    ("greater boston", "Boston"),
    ("greater chicago area", "Chicago"),
    ("los angeles metropolitan area", "Los Angeles"),
    ("washington dc-baltimore area", "Washington"),
    ("washington dc metropolitan area", "Washington"),
    ("dallas-fort worth metroplex", "Dallas"),
    ("greater houston", "Houston"),
    ("greater phoenix area", "Phoenix"),
    ("greater atlanta area", "Atlanta"),
]
STATE_METRO_MAP = [
    ("san francisco bay area", "CA"),
    ("new york", "NY"),
    ("greater seattle", "WA"),
    ("greater boston", "MA"),
    ("greater chicago", "IL"),
    ("los angeles", "CA"),
    ("washington dc", "DC"),
    ("dallas", "TX"),
    ("houston", "TX"),
    ("phoenix", "AZ"),
    ("atlanta", "GA"),
]
ERROR_BANDS = ([0, 40_000, 70_000, 100_000, 140_000, 200_000, 300_001],
               ["<$40K", "$40K-70K", "$70K-100K", "$100K-140K", "$140K-200K", "$200K+"])

# own stop list: English function words, dropped before word pairs are formed
STOP_WORDS = """
a about above after again against all also am an and any are as at be because been before being below
between both but by can could did do does doing down during each either every few for from further had has
have having he her here hers him his how if in into is it its itself just may me might more most must my
neither no nor not now of off on once only or other our ours out over own per same shall she should since so
some such than that the their theirs them then there these they this those through to too under until up upon
us very via was we were what when where whether which while who whom whose why will with within without would
you your yours
""".split()

# fixed value: description of a requested role of which nothing is known
ROLE_DEFAULT = "Collaborate with cross-functional teams and support role-specific responsibilities."

#: reports shown in a fixed label order: query -> (column, labels in order)
URGENCY_ORDER = ["high", "medium", "low"]
REPORT_ORDER = {
    "q01_1": ("formatted_experience_level", EXPERIENCE_LEVELS_ALL),
    "q01_5": ("formatted_experience_level", EXPERIENCE_LEVELS),
    "q01_6": ("size_label", SIZE_ORDER),
    "q03_3": ("urgency", URGENCY_ORDER),
    "q04_1": ("salary_band", SALARY_BANDS_REPORT[1]),
    "q04_2": ("salary_band", SALARY_BANDS_REPORT[1]),
    "q10_3": ("formatted_experience_level", EXPERIENCE_LEVELS),
    "q11_1": ("formatted_experience_level", EXPERIENCE_LEVELS),
    "q11_5": ("formatted_experience_level", EXPERIENCE_LEVELS),
    "q12_5": ("formatted_experience_level", EXPERIENCE_LEVELS),
    "q13_3": ("formatted_experience_level", EXPERIENCE_LEVELS),
    "q13_4": ("salary_band", SALARY_BANDS_REPORT[1]),
    "benefit_summary": ("benefit_bucket", BENEFIT_BUCKETS[1]),
    "baseline_error_by_band": ("band", ERROR_BANDS[1]),
}
