"""Word lists, patterns and tables that decide results.  Fixed values, given as data."""

# Words that carry no meaning in a search.
STOPWORDS = (
    "the a an is are was were be been of to in on for and or if it this that with as at by from can do does i you we my "
    "your me what how much many please tell about there any have has"
).split()

# Code point ranges of scripts.
SCRIPTS = {
    "hi": ("0900", "097F"), "bn": ("0980", "09FF"), "pa": ("0A00", "0A7F"), "gu": ("0A80", "0AFF"),
    "ta": ("0B80", "0BFF"), "te": ("0C00", "0C7F"), "kn": ("0C80", "0CFF"), "ur": ("0600", "06FF"),
}

# Canonical terms and their aliases.
TERMS = {
    "emi": ["emi", "instalment", "installment", "monthly payment", "monthly instalment", "monthly repayment", "angsuran", "cicilan"],
    "processing_fee": ["processing fee", "processing charges", "login fee", "upfront fee", "administration fee", "biaya administrasi"],
    "foreclosure": ["foreclosure", "pre-closure", "preclosure", "prepayment", "part payment", "part-prepayment", "pelunasan dipercepat"],
    "business_vintage": ["business vintage", "vintage", "years in business", "years of operation", "business continuity", "umur usaha"],
    "turnover": ["turnover", "annual turnover", "annual sales", "gross receipts", "revenue", "omzet"],
    "bureau_score": ["cibil", "cibil score", "bureau score", "credit score", "credit bureau score"],
    "collateral": ["collateral", "security", "unsecured", "without collateral", "agunan", "jaminan"],
    "overdue": ["overdue", "past due", "delinquent", "dpd", "arrears", "jatuh tempo", "tunggakan", "lapse", "lapsed"],
    "penal_charge": ["penal charge", "penal interest", "late payment charge", "bounce charge", "denda", "late fee"],
    "tenure": ["tenure", "tenor", "loan term", "repayment period", "jangka waktu"],
    "disbursal": ["disbursal", "disbursement", "loan release", "pencairan"],
    "grievance": ["grievance", "complaint", "escalation", "nodal officer", "ombudsman", "redressal"],
    "kyc": ["kyc", "know your customer", "identity proof", "address proof", "pan card", "aadhaar"],
}

# Category keywords in order of precedence ("faq" is decided by the heading).
CATEGORIES = {
    "objection": ["objection", "obj-0", "rebuttal", "not interested", "competitor"],
    "partnership": ["branch partner", "dsa", "direct selling agent", "lending service provider", "connector", "partner payout", "referral program", "gem sahay"],
    "compliance": ["fair practices", "grievance", "ombudsman", "nodal officer", "redressal", "privacy policy", "fraud", "kyc", "regulator", "reserve bank"],
    "pricing": ["processing fee", "schedule of charges", "rate of interest", "penal", "bounce charge", "foreclosure charge", "reference rate", "per annum", "pricing grid", "% p.a"],
    "eligibility": ["eligibility", "eligible", "vintage", "turnover", "bureau", "cibil", "qualification", "rule_id", "criteria", "who can apply", "age"],
    "process": ["documents required", "document checklist", "how to apply", "application form", "loan process", "turnaround", "disbursal", "section a -", "form bl-"],
    "faq": [],
    "product": ["loan amount", "tenure", "collateral", "product", "finance", "facility", "up to inr", "loan against property", "machinery"],
    "company": ["about us", "branch", "head office", "contact", "customer care", "leadership"],
}
DOCUMENT_CATEGORIES = {"objection_handbook": "objection", "qualification_rules": "eligibility", "partner_faq": "partnership", "application_form": "process"}

# Product keywords.
PRODUCTS = {
    "unsecured_business_loan": ["business loan", "unsecured", "without collateral", "working capital"],
    "loan_against_property": ["loan against property", "lap", "property-backed", "secured loan"],
    "machinery_finance": ["machinery", "equipment finance", "oem", "cnc"],
    "supply_chain_finance": ["supply chain", "anchor", "embedded financing", "retailer finance", "merchant lending"],
    "partner_programme": ["branch partner", "dsa", "lending service provider", "connector", "referral", "gem sahay"],
}

# Patterns of personal data, in order of precedence.
PII_PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "phone_in": r"(?<!\d)(?:\+91[\s-]?)?[6-9]\d{4}[\s-]?\d{5}(?!\d)",
    "phone_intl": r"(?<!\d)\+(?:62|63)[\s-]?\d[\d\s-]{7,12}(?!\d)",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "aadhaar": r"(?<!\d)\d{4}[\s-]?\d{4}[\s-]?\d{4}(?!\d)",
    "bank_account": r"(?i)\b(?:a/?c|account)\s*(?:no\.?|number)?\s*[:#]?\s*(\d{9,18})\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "gstin": r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b",
    "pincode_address": r"(?i)\b\d{6}\b(?=[^\d]*(?:india|road|street|nagar|colony))",
}
PII_MASKS = {
    "email": "[EMAIL_REDACTED]", "phone_in": "[PHONE_REDACTED]", "phone_intl": "[PHONE_REDACTED]", "pan": "[PAN_REDACTED]",
    "aadhaar": "[AADHAAR_REDACTED]", "bank_account": "[ACCOUNT_REDACTED]", "ifsc": "[IFSC_REDACTED]", "gstin": "[GSTIN_REDACTED]",
    "pincode_address": "[PINCODE_REDACTED]", "person_name": "[NAME_REDACTED]",
}
PII_SAFE_BEFORE = r"(?i)(?:INR|rs\.?|₹|turnover|amount|limit|crore|lakh|version|clause|section|page)\s*$"
NAME_FIELD = r"(full_name|applicant name|customer name|name)\s*:\s*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3})"
PAN_HOLDERS = "ABCFGHLJPTK"

# The multiplication and permutation tables of the Verhoeff checksum.
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6], [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1], [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4], [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2], [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1], [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]

# Decision rules (id, product, slot, operator, value, disposition, reason code).
RULES = [
    ("QR001", "unsecured_business_loan", "entity_type", "in", "proprietorship|partnership|llp|private_limited", "pass", "ENTITY_OK"),
    ("QR002", "unsecured_business_loan", "entity_type", "in", "trust|society|huf", "reject", "ENTITY_NOT_SERVED"),
    ("QR003", "unsecured_business_loan", "business_vintage_months", "gte", "36", "pass", "VINTAGE_OK"),
    ("QR004", "unsecured_business_loan", "business_vintage_months", "between", "24|35", "refer", "VINTAGE_BORDERLINE"),
    ("QR005", "unsecured_business_loan", "business_vintage_months", "lt", "24", "reject", "VINTAGE_SHORT"),
    ("QR006", "unsecured_business_loan", "annual_turnover_inr", "gte", "4000000", "pass", "TURNOVER_OK"),
    ("QR007", "unsecured_business_loan", "annual_turnover_inr", "between", "2500000|3999999", "refer", "TURNOVER_BORDERLINE"),
    ("QR008", "unsecured_business_loan", "annual_turnover_inr", "lt", "2500000", "reject", "TURNOVER_LOW"),
    ("QR009", "unsecured_business_loan", "loan_amount_inr", "between", "300000|5000000", "pass", "AMOUNT_OK"),
    ("QR010", "unsecured_business_loan", "loan_amount_inr", "gt", "5000000", "refer", "AMOUNT_HIGH"),
    ("QR011", "unsecured_business_loan", "credit_score", "gte", "700", "pass", "BUREAU_OK"),
    ("QR012", "unsecured_business_loan", "credit_score", "between", "675|699", "refer", "BUREAU_BORDERLINE"),
    ("QR013", "unsecured_business_loan", "credit_score", "lt", "675", "reject", "BUREAU_LOW"),
    ("QR014", "unsecured_business_loan", "gst_registered", "eq", "true", "pass", "GST_OK"),
    ("QR015", "unsecured_business_loan", "gst_registered", "eq", "false", "refer", "GST_MISSING"),
    ("QR016", "unsecured_business_loan", "industry", "in", "gambling|crypto_trading|arms|tobacco_manufacturing|money_lending", "reject", "NEGATIVE_LIST"),
    ("QR017", "unsecured_business_loan", "applicant_age", "between", "24|65", "pass", "AGE_OK"),
    ("QR018", "unsecured_business_loan", "applicant_age", "outside", "24|65", "reject", "AGE_OUT"),
    ("QR019", "loan_against_property", "loan_amount_inr", "between", "1000000|50000000", "pass", "LAP_AMOUNT_OK"),
    ("QR020", "loan_against_property", "property_type", "in", "residential|commercial|industrial", "pass", "LAP_PROPERTY_OK"),
]

# Cues in a customer's words, with the confidence of the signal.
CROSS_SELL = {
    "second_vehicle": ["second (car|vehicle|bike|truck)", "another (car|vehicle|truck|bike)", "two (cars|vehicles|trucks)", "mobil kedua", "kendaraan lain"],
    "second_property": ["another (shop|property|godown|warehouse|outlet)", "second (shop|property|branch)", "new branch", "another location"],
    "expansion": ["expand", "expansion", "new machine", "another machine", "scaling up", "grow the business", "buka cabang", "mag-expand"],
    "family_cover": ["my (wife|husband|son|daughter|family)", "for my kids", "asawa ko", "anak ko", "istri saya", "anak saya"],
}
CUSTOMER_CUES = {
    "payment_difficulty": (0.85, ["can'?t pay", "cannot pay", "no money", "short of (funds|cash)", "tight (this )?month", "lost my job", "business is down", "slow (season|month)", "delay the payment", "wala akong pambayad", "walang pera", "hindi ko kaya", "belum ada uang", "belum ada dana", "tidak sanggup", "berat bulan ini", "nggak ada uang"]),
    "frustration": (0.7, ["third time", "again and again", "already told you", "not listening", "waste of time", "ridiculous", "fed up", "annoyed", "frustrated", "keeps? happening", "no one helps", "pang-ilang beses", "nakakainis", "sawa na ako", "sudah berkali-kali", "capek", "kesal", "gimana sih"]),
    "buying_signal": (0.7, ["how (soon|fast|quickly)", "soon can i", "when can i get", "when do i get", "what documents", "how do i apply", "send me the", "what'?s the next step", "i'?m interested", "let'?s do it", "kailan po", "anong requirements", "kapan bisa", "syaratnya apa", "gimana caranya"]),
    "competitor_mention": (0.8, ["bajaj", "hdfc", "icici", "axis", "kotak", "tata capital", "lendingkart", "indifi", "another (lender|bank|company)", "other (lender|bank)", "competitor", "ibang bangko", "leasing lain", "finance lain"]),
    "callback_request": (0.8, ["call me (back|later)", "call me tomorrow", "ring me", "later i will call", "tawagan mo ako", "tawag na lang", "telepon lagi", "hubungi lagi", "nanti saya kabari"]),
    "human_request": (0.95, ["real person", "speak to (a|an) (human|person|agent|officer)", "talk to someone", "transfer me", "tao naman", "sa tao", "bicara dengan orang", "petugas manusia"]),
    "soft_refusal": (0.75, ["nanti saya kabari", "nanti deh", "iya nanti", "belum ada kabar", "lihat nanti", "diusahakan", "kalau ada rezeki"]),
}
# What an agent must not say.
RISKY_STATEMENTS = ["guarantee[ds]?", "100 ?% approval", "definitely (approved|get it|approve)", "i (can )?promise", "promise you", "assured (approval|sanction)", "no interest at all", "free money", "(i|we)('ll| will)? waive", "waive the (penalty|charge|fee|denda)", "no processing fee for you", "pasti (disetujui|cair)", "dijamin cair", "sigurado(ng)? approved"]
# What an agent must say, by when (seconds), and the words that say it.
CHECKLIST = [
    ("ai_disclosure", 45.0, ["ai assistant", "not a human", "hindi po tao", "asisten ai", "bukan petugas manusia", "automated assistant", "virtual assistant"]),
    ("recording_disclosure", 45.0, ["recorded", "recording", "naka-record", "direkam"]),
    ("no_payment_disclosure", 60.0, ["will not ask for", "hindi po ako hihingi", "tidak akan meminta", "otp"]),
]
# Per kind of signal its priority (lower is more important), topic group and template.
NUDGES = {
    "compliance_gap": (1, "compliance_disclosure", "Required disclosure missing: {detail} Say it before continuing."),
    "risky_statement": (1, "compliance_conduct", "Careful - that sounded like a guarantee. Re-frame: decision rests with credit."),
    "risk": (1, "compliance_conduct", "Compliance risk: {detail}"),
    "human_request": (2, "logistics", "Customer asked for a human. Stop qualifying and hand off."),
    "payment_difficulty": (2, "payment", "Payment difficulty. Offer the approved support path - do not promise a waiver."),
    "rising_frustration": (2, "sentiment", "Frustration building. Acknowledge it, then slow down."),
    "frustration": (2, "sentiment", "Frustration rising. Acknowledge the concern before asking anything else."),
    "repeated_question": (3, "sentiment", "Third time asked. Answer it directly or escalate to a human."),
    "soft_refusal": (3, "payment", "That was an indirect no. Pin a specific date or log it as no commitment."),
    "competitor_mention": (3, "objection", "Competitor named. Compare on total cost and turnaround, do not disparage."),
    "confusion": (3, "context", "Customer seems lost. Re-explain in one plain sentence."),
    "buying_signal": (4, "opportunity", "Buying signal: {detail} Move to next steps now."),
    "missed_cross_sell": (4, "opportunity", "Opportunity: {detail} Mention the relevant product before closing."),
    "missed_opportunity": (4, "opportunity", "Opportunity: {detail}"),
    "callback_request": (4, "logistics", "Callback requested. Confirm a specific slot before ending."),
    "topic_shift": (5, "context", "Topic moved on: {detail} Follow the customer."),
}
CONFIDENCE_FLOOR = 0.55
KIND_FLOORS = {"missed_opportunity": 0.88, "topic_shift": 0.88, "confusion": 0.85, "buying_signal": 0.75}
COOLDOWN_S, TIME_TO_LIVE_S, MAX_ACTIVE = 45.0, 90.0, 3

# Number words, unit words and scale words of spoken amounts.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "twenty five": 25, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "half": 0.5,
    "ek": 1, "do": 2, "teen": 3, "chaar": 4, "paanch": 5, "das": 10, "saade": 0.5,
}
SPOKEN_DIGITS = {
    "nol": 0, "satu": 1, "dua": 2, "tiga": 3, "empat": 4, "lima": 5, "enam": 6, "tujuh": 7, "delapan": 8, "sembilan": 9,
    "isa": 1, "dalawa": 2, "tatlo": 3, "apat": 4, "anim": 6, "pito": 7, "walo": 8, "siyam": 9, "sampu": 10,
}
SMALL_SCALES = {"puluh": 10, "ratus": 100, "daan": 100, "raan": 100, "gatos": 100}
BIG_SCALES = {"ribu": 1_000, "libo": 1_000, "juta": 1_000_000, "milyon": 1_000_000, "miliar": 1_000_000_000, "milyar": 1_000_000_000}
BOUND_ONES = {"seribu": 1_000, "seratus": 100, "sejuta": 1_000_000, "sepuluh": 10, "semilyar": 1_000_000_000}
NOTHING = ["no", "none", "nil", "nothing", "zero", "no emi", "no emis", "not any", "nahi", "koi nahi", "wala", "tidak ada", "belum ada"]
CURRENCY = r"₹|rs\.|\brs\b|\binr\b|\brp\b|\bidr\b|₱|\bphp\b|\bpeso[s]?\b|\bpiso\b|\brupiah\b"
AMOUNT_UNITS = r"crore|cr\b|lakh|lakhs|lac|lacs|million|mn\b|miliar|milyar|juta|ribu|libo|milyon|k\b|thousand"
AFFIRM = "yes yeah yep haan ha correct right sure true opo oo ya iya betul sige done registered".split()
DENY = ["no", "nope", "nahi", "nahin", "not yet", "never", "hindi", "wala", "tidak", "nggak", "gak", "belum", "false", "unregistered"]
ENTITIES = {
    "proprietorship": ["proprietor", "proprietorship", "sole proprietor", "individual", "single owner", "my own", "prop"],
    "partnership": ["partnership", "partner firm", "partners", "firm"],
    "llp": ["llp", "limited liability"],
    "private_limited": ["private limited", "pvt ltd", "pvt. ltd", "pvt", "private ltd", "company", "p ltd"],
    "trust": ["trust"],
    "society": ["society", "co-operative", "cooperative"],
    "huf": ["huf", "hindu undivided"],
}
INDUSTRIES = {
    "gambling": ["gambling", "betting", "casino", "satta"],
    "crypto_trading": ["crypto", "bitcoin", "cryptocurrency trading"],
    "arms": ["arms", "ammunition", "firearms"],
    "tobacco_manufacturing": ["tobacco manufacturing", "gutkha", "cigarette manufacturing"],
    "money_lending": ["money lending", "moneylending", "chit fund", "sahukar"],
}

# Words of distress that call for a person, and numbers that claim nothing.
DISTRESS = r"\b(complaint|complain|ombudsman|consumer court|legal notice|lawyer|harass|sue|rbi|nodal officer|stop calling|do not call|reklamo|demanda|pengaduan|lapor polisi)\b"
SAFE_NUMBERS = ["1", "2", "3", "one", "two", "three"]

# Page cleaning.
BLOCK_TAGS = "h1 h2 h3 h4 h5 h6 p li td th dt dd blockquote button summary".split()
STRIP_TAGS = "script style noscript nav header footer svg iframe select option aside".split()
UI_PHRASES = ["apply now", "submit", "read more", "know more", "close", "menu", "next", "previous", "search", "login", "sign in", "download", "view all", "back", "explore", "contact us", "get started", "calculate", "reset", "send otp"]
MIN_BUTTON_CHARS, BOILERPLATE_SHARE, THIN_CHARS = 15, 0.35, 400
MISSING_PAGE = ["page not found", "404 not found", "sorry, the page", "does not exist"]
PDF_LANGUAGES = "hindi punjabi urdu telugu tamil marathi kannada bengali gujarati odia assamese malayalam".split()
PDF_KEYWORDS = "fair-practice fair_practice ombudsman grievance charges pricing policy kyc code-of-conduct interest-rate english".split()

# What a recogniser writes for silence.
SILENCE = [
    "thank you", "thank you very much", "thank you so much", "thanks for watching", "thank you for watching", "thanks for listening",
    "please subscribe", "like and subscribe", "subscribe to my channel", "you", "the", "and", "so", "i", "a", "silence", "music",
    "applause", "background music", "beep", "amara.org", "subtitles by the amara.org community", "subtitles by the amara.org community.",
    "transcription by castingwords", "www.mooji.org", "terima kasih", "terima kasih telah menonton", "salamat po", "salamat sa panonood",
    "ご視聴ありがとうございました", "ご視聴ありがとうございます", "ありがとうございました", "お疲れ様でした", "谢谢大家", "谢谢观看",
    "字幕由网友提供", "시청해주셔서 감사합니다", "ขอบคุณครับ", "спасибо за просмотр", "gracias por ver el video", "suscríbete al canal",
    "obrigado por assistir", "merci d'avoir regardé cette vidéo", "untertitel im auftrag des zdf", "hãy đăng ký kênh",
]
NON_LATIN = r"[\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0900}-\x{097F}\x{0E00}-\x{0E7F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"

# The slots of an application that a decision needs, and the order of asking.
REQUIRED_SLOTS = ["entity_type", "business_vintage_months", "annual_turnover_inr", "loan_amount_inr"]
ASK_ORDER = ["business_name", "entity_type", "industry", "business_vintage_months", "annual_turnover_inr", "loan_amount_inr", "loan_purpose", "existing_emi_inr", "gst_registered"]
# The categories that a search for an intent may look into.
INTENT_CATEGORIES = {
    "question": ["product", "eligibility", "pricing", "process", "faq", "policy", "compliance", "partnership", "company"],
    "objection": ["objection", "pricing", "product", "faq", "policy", "eligibility"],
}

# The parser of each slot, the parsers that a market may name, and what counts as unsaid.
SLOT_PARSERS = {
    "business_name": "text", "entity_type": "entity_type", "industry": "industry", "business_vintage_months": "months", "annual_turnover_inr": "amount",
    "loan_amount_inr": "amount", "loan_purpose": "text", "existing_emi_inr": "amount", "gst_registered": "bool", "city": "city", "applicant_age": "age", "credit_score": "credit_score",
}
PARSERS = ["text", "city", "amount", "months", "bool", "int", "entity_type", "industry", "age", "credit_score"]
UNSAID = ["", "unknown", "not provided"]
# The words of a decision's summary.
INCOMPLETE_HEAD = "Decision not possible yet. Still missing: "
DECISION_HEADS = {
    "pass": "The customer meets the documented criteria for an in-principle review.",
    "refer": "The file is borderline and must be reviewed by a credit officer.",
    "reject": "The file does not meet the documented criteria.",
}
CONFLICT_HEAD = " Note these inconsistencies in what the customer said, and ask about them before closing: "
# Asking to hear something again.
REPEAT_REQUEST = r"(repeat that|say (that )?again|come again|pardon|what was that|didn'?t (catch|hear)|could you repeat|once more|ulangi|paki-ulit|pakiulit)"
# How records name the kind of their source.
SOURCE_LABELS = {"website": "website: ", "website_pdf": "published PDF: "}
OTHER_SOURCE_LABEL = "internal document (synthetic, authored for this assessment): "
# Notations of dates, and of rupee amounts with and without a scale.
DATE_PATTERNS = {
    "dmy": r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b",
    "ymd": r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b",
    "mdy": r"\b([A-Za-z]{3,9})\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})\b",
    "dmonthy": r"\b(\d{1,2})(?:st|nd|rd|th)?\s+([A-Za-z]{3,9}),?\s+(\d{4})\b",
}
RUPEES = r"(?i)(?<![A-Za-z])(?:rs\.?|inr|₹)\s*"
SCALED_AMOUNT = RUPEES + r"([\d,]+(?:\.\d+)?)\s*(lakhs?|lac|crore|cr)\b"
PLAIN_AMOUNT = RUPEES + r"(\d[\d,]{2,})(?![\d,]*(?:\.\d+)?\s*(?:lakhs?|lac|crore|cr)\b)(?!\d)"
# The market of records that name none.
HOME_MARKET = "IN"
# How lines begin that no chunk may cut.
ROW_STARTS = ("| ", "- rule_id", "| rule_id")
