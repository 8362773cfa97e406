"""Word lists and rule tables of the institute's vocabulary, in the order in which they apply."""

# Branch aliases and values that mean "not recorded".
BRANCH_ALIASES = {"city light": "citylight", "city-light": "citylight", "clt": "citylight", "vesu branch": "vesu", "pal branch": "pal", "palanpur patiya": "pal"}
BRANCHES = ["citylight", "vesu", "pal"]
LOCALITY_BRANCH = {"adajan": "pal"}
BLANKS = ["", "na", "n/a", "none", "-", "nil"]

# Spelling corrections of course names.
COURSE_SPELLING = [
    (r"developmnet|devlopemnet|develpment", "development"),
    (r"dipolma|dimploma", "diploma"),
    (r"graohic|grapic\b", "graphic"),
    (r"illustartor|illustrat[ao]r", "illustrator"),
    (r"advancced|advanc?e\b", "advanced"),
    (r"digitalmarketing", "digital marketing"),
    (r"digtal", "digital"),
    (r"analystics", "analytics"),
    (r"compter", "computer"),
    (r"premiere?\b", "premier"),
    (r"psudo|pseudo", "pseudo"),
]

# Module suffixes of course names.
COURSE_MODULES = [
    r"[\(\[]\s*(m(?:odules?)?\s*[-_ ]?\s*\d[^\)\]]*)\s*[\)\]]",
    r"[\(\[]\s*((?:all\s*)?\d*\s*modules?[^\)\]]*)\s*[\)\]]",
    r"[\(\[]\s*(\d\s*(?:&|,|to|and)\s*[^\)\]]*)\s*[\)\]]",
    r"\b(\d\s*&\s*\d)\b",
    r"\b(m[-_ ]?\d(?:\s*&\s*m?[-_ ]?\d)*)\b",
]

# Course families.
COURSE_FAMILIES = [
    (r"\bcombo\b", "combo course"),
    (r"cert.*python|python.*cert", "adv certificate: python & generative ai"),
    (r"cert.*(data analy|data science)|(data analy|data science).*cert", "adv certificate: data analytics & data science"),
    (r"cert.*digital|digital.*cert", "adv certificate: digital designing & marketing"),
    (r"agentic\s*ai", "agentic ai & automation"),
    (r"\bschool\b|\bcbse\b|\b\d{1,2}\s*th\b|\b\d{1,2}\s+(?:ip|cs|ib)\b|\((?:ip|cs)\)", "school course"),
    (r"full\s*stack", "full stack development"),
    (r"front[\s-]*end", "front end development"),
    (r"web\s*develop", "web development"),
    (r"web\s*design", "web designing"),
    (r"wordpress", "wordpress"),
    (r"ui\s*[&/]?\s*ux|ux\s*[&/]?\s*ui", "ui ux designing"),
    (r"business analy", "business analytics"),
    (r"financial model", "financial modelling"),
    (r"excel", "advanced excel"),
    (r"power\s*bi", "power bi"),
    (r"data analy", "data analysis"),
    (r"\bsql\b", "sql"),
    (r"social media", "social media marketing"),
    (r"ecommerce|e-commerce", "ecommerce & seo"),
    (r"performance advertising|digital marketing|\bdm\b|\bseo\b|digital advert", "digital marketing & seo"),
    (r"graphic|photoshop|illustrator|corel|canva|premier|lightroom|after effects|video edit|package design|reels|e-invite|cinematic|cgi|3d packag|vfx", "graphic designing"),
    (r"tally|accounting|\bgst\b|zoho", "accounting"),
    (r"\bjava\b", "java programming"),
    (r"data structure", "data structures & algorithms"),
    (r"pseudo", "programming logic"),
    (r"scratch", "scratch programming"),
    (r"python", "python programming"),
    (r"c\+\+.*(?<![\w+])c(?![\w+])|(?<![\w+])c(?![\w+]).*c\+\+", "c & c++ programming"),
    (r"c\+\+", "c++ programming"),
    (r"(?<![\w+])c(?![\w+]).*program", "c programming"),
    (r"\br\s+programming\b", "r programming"),
    (r"data science|machine learning|deep learning", "data science & ai"),
    (r"professional office|\boffice\b", "office & generative ai"),
    (r"computer basic|\bbasics\b|\bkids\b|typing|ms paint|generative ai foundation", "computer basics"),
]

# Reporting category of each course family, and anchors that decide before the family.
FAMILY_CATEGORY = {
    "combo course": "Office & Productivity",
    "adv certificate: python & generative ai": "Programming & Development",
    "adv certificate: data analytics & data science": "Data & Analytics",
    "adv certificate: digital designing & marketing": "Digital Marketing",
    "agentic ai & automation": "Programming & Development",
    "school course": "Foundational/School",
    "full stack development": "Programming & Development",
    "front end development": "Programming & Development",
    "web development": "Programming & Development",
    "web designing": "Design & Creative",
    "wordpress": "Programming & Development",
    "ui ux designing": "Design & Creative",
    "business analytics": "Data & Analytics",
    "financial modelling": "Accounting & Finance",
    "advanced excel": "Office & Productivity",
    "power bi": "Office & Productivity",
    "data analysis": "Data & Analytics",
    "sql": "Programming & Development",
    "social media marketing": "Digital Marketing",
    "ecommerce & seo": "Digital Marketing",
    "digital marketing & seo": "Digital Marketing",
    "graphic designing": "Design & Creative",
    "accounting": "Accounting & Finance",
    "java programming": "Programming & Development",
    "data structures & algorithms": "Programming & Development",
    "programming logic": "Programming & Development",
    "scratch programming": "Programming & Development",
    "python programming": "Programming & Development",
    "c & c++ programming": "Programming & Development",
    "c++ programming": "Programming & Development",
    "c programming": "Programming & Development",
    "r programming": "Programming & Development",
    "data science & ai": "Data & Analytics",
    "office & generative ai": "Office & Productivity",
    "computer basics": "Office & Productivity",
}
CATEGORY_ANCHORS = [(r"\bkids?\b", "Foundational/School"), (r"computer\s*basic|professional\s*office", "Office & Productivity")]

# Lead sources.
LEAD_SOURCES = [
    (r"hoarding|banner|pamphlet|poster|\bwalk\s*\w*|walkin|\bvisit|passing by|near\s*by|nearby|news\s*paper|newspaper|\bprint\b|magazine|radio|\btv\b", "Walk-in"),
    (r"old\s*\w*\s*student|ex\s*student|was a student|frie?n?ds?\b|family|relative|referr?al|refer|refre|word of mouth|known|neighbou?r|brother|sister|sibling|cousin|parent|colleague|old\s*enquiry", "Referral"),
    (r"goog\w*|internet|online|social|facebook|instagram|insta\b|youtube|whatsapp|website|\bweb\b|\bnet\b|indiamart|justdial|just dial|\bsms\b|\bad(?:vertisement|vert)?\b|\bads\b|linkedin|\bseo\b", "Online/Google/Social"),
]
LEAD_BLANKS = ["", "na", "n.a", "n/a", "none", "-", "nil", "nan"]
EXPLICIT_OTHER = ["other", "others", "unknown"]

# Occupations.
OCCUPATIONS = [
    (r"house\s*wife|home\s*maker|housewife", "Housewife"),
    (r"\bstudent\b|\bstudying\b|\bschool\b|\bcollege\b|\b\d{1,2}\s*th\b|\bpursuing\b", "Student"),
    (r"\bretired\b", "Other"),
    (r"\bunemployed\b|not working|no\s*job", "Other"),
    (r"business|\bjob\b|service|\bwork(?:ing)?\b|teacher|tutor|lawyer|advocate|doctor|engineer|accountant|\bca\b|event planner|diamond|shop|trader|manager|employee|self\s*employ", "Business / Job"),
]

# Payment channels in free text.
PAYMENT_CHANNELS = [
    (r"razorpay|\bemi\b|bajaj", "emi"),
    (r"cheque|\bchq\b|check\s*no", "cheque"),
    (r"\bupi\b|gpay|google\s*pay|phonepe|paytm", "upi"),
    (r"icici|hdfc|\bsbi\b|axis|kotak|neft|imps|rtgs|\bbank\b", "bank_transfer"),
    (r"\bcash\b", "cash"),
]

# Markers within names.
CANCEL_MARK = r"cancel+ed|cancell?ed|cancel|canceled|cancled|left|dropped|discontinued"
STATUS_MARKS = [(r"refund", "refunded"), (CANCEL_MARK, "cancelled"), (r"not\s+coming", "not_coming"), (r"register(?:ed)?\s+for\s+trial|\btrial\b", "trial")]
FAST_TRACK_MARK = r"fast\s*track|\bft\b"
NOTE_MARK = r"only\s+till|till\s+\w+|don'?t\s+delete|register(?:ed)?\s+for"

# Lifecycle vocabulary of a column, and of a source's name.
LIFECYCLE_VALUES = {
    "course completed": "completed",
    "completed": "completed",
    "complete": "completed",
    "finished": "completed",
    "currently learning": "active",
    "learning": "active",
    "ongoing": "active",
    "active": "active",
    "running": "active",
    "not coming": "not_coming",
    "not_coming": "not_coming",
    "discontinued": "not_coming",
    "dropped": "not_coming",
    "left": "not_coming",
    "not to entertain": "not_to_entertain",
    "not to entertrain": "not_to_entertain",
}
LIFECYCLE_UNKNOWN = ["unknown"]
LIFECYCLE_BY_SOURCE = [("complete", "completed"), ("not_coming", "not_coming"), ("not coming", "not_coming"), ("entertain", "not_to_entertain"), ("main_data", "active"), ("time_table", "active"), ("timetable", "active")]
LIFECYCLE_PRECEDENCE = ["completed", "not_to_entertain", "not_coming", "active"]

# Header words that claim a role (first role wins), and words that forbid it.
ROLES = {
    "dob": (["date of birth", "dob", "birth date"], []),
    "admission_date": (["date of admission", "admission_date"], ["birth"]),
    "joining_date": (["date of joining", "joining", "doj", "enrolled"], ["birth"]),
    "receipt_date": (["date of receipt", "receipt date"], []),
    "issue_date": (["certificate issue", "issue date", "issued"], []),
    "enquiry_date": (["timestamp", "enquiry", "lead_date", "created"], ["birth"]),
    "receipt_id": (["receipt id", "receipt-id"], []),
    "certificate_number": (["certificate number", "certificate no", "certificate-id"], []),
    "student_id": (["student-id", "student id", "student_id"], []),
    "course_category": (["course category", "category"], []),
    "course": (["course", "which course", "program", "service", "product"], ["category", "duration", "remain"]),
    "course_duration": (["course duration", "duration"], []),
    "days_remaining": (["days remaning", "days remaining", "remain"], []),
    "amount": (["total fees", "total fee", "amount", "revenue", "price"], ["pending", "paid"]),
    "paid": (["paid amt", "paid", "collected", "received"], []),
    "pending": (["amt pending", "pending", "due", "outstanding", "balance"], []),
    "payment_mode": (["mode of payment", "payment mode"], []),
    "description": (["description", "narration", "particular"], []),
    "status_reason": (["status & reason", "reason for not coming"], []),
    "status": (["status", "stage"], []),
    "enquiry_mode": (["mode of enquiry", "enquiry mode"], []),
    "admission_mode": (["mode of admission", "admission mode"], []),
    "mode": (["mode"], ["payment", "enquiry", "admission"]),
    "email": (["email", "e-mail"], []),
    "parent_mobile": (["mobile no (parent", "mobile no (father", "guardian 1", "parent", "guardian"], ["mother", "guardian 2"]),
    "parent_mobile_2": (["mobile no (mother", "mother", "guardian 2", "secondary contact"], []),
    "student_mobile": (["mobile no (student", "mobile", "phone", "contact no", "whatsapp"], []),
    "residential_area": (["residential area", "area"], ["address"]),
    "address": (["address", "residential", "street", "addr"], []),
    "pincode": (["pincode", "pin code", "zip", "postal"], []),
    "photo": (["photo", "image"], []),
    "counsellor": (["counsellor", "counselor"], []),
    "name": (["student name", "name of student", "name"], ["google", "course", "tutor", "faculty", "branch", "category", "counsellor", "counselor"]),
    "preferred_branch": (["preferred branch"], []),
    "branch": (["branch", "centre", "center", "region", "office"], ["preferred"]),
    "source": (["from where", "source", "channel", "referral", "utm", "how did"], []),
    "faculty": (["faculty", "tutor", "trainer", "assigned to", "agent"], []),
    "student_category": (["student category", "category"], ["course"]),
    "education": (["education level", "education", "qualification"], ["details"]),
    "occupation": (["presently what", "occupation", "currently doing"], []),
    "education_details": (["education details"], []),
    "preferred_batch_time": (["preferred batch time", "preferred batch"], []),
    "batch_time": (["batch timing", "batch time", "slot", "shift"], ["preferred"]),
    "preferred_days": (["preferred days"], ["remain"]),
    "class_days": (["days"], ["remain", "preferred", "duration"]),
    "coupon_given": (["coupon"], []),
    "notes": (["any other notes", "notes", "more info"], []),
}
PII_ROLES = ["name", "email", "student_mobile", "parent_mobile", "parent_mobile_2", "address", "dob", "photo"]

# Pairs of roles worth crossing.
CROSS_PAIRS = [
    ("branch", "course"),
    ("branch", "faculty"),
    ("branch", "source"),
    ("branch", "payment_mode"),
    ("course", "faculty"),
    ("course", "batch_time"),
    ("course", "source"),
    ("course", "student_category"),
    ("faculty", "batch_time"),
    ("faculty", "student_category"),
    ("source", "student_category"),
    ("branch", "student_category"),
    ("branch", "class_days"),
    ("course", "class_days"),
    ("payment_mode", "student_category"),
]

# Header words of personal columns that no role claims.
PII_HEADERS = ["name for google", "mobile no", "phone", "contact no", "whatsapp", "email", "e-mail", "address", "residential", "date of birth", "photo", "aadhaar", "aadhar"]

# The alternative role sets of each metric. date_any is any event date; cancel_marker, stale_enquiry, repeat_person and lifecycle_column are told by
# values; completion_source by the names of sources.
REQUIREMENTS = {
    "admission_conversion_rate": [["admission_date"], ["joining_date"]],
    "counselling_to_admission_rate": [["admission_date"], ["joining_date"]],
    "admissions_confirmed": [["date_any"]],
    "total_leads": [["date_any"]],
    "qualified_leads": [["date_any"]],
    "walk_in_count": [["date_any"]],
    "enquiry_backlog_rate": [["stale_enquiry"]],
    "lead_to_admission_days": [["enquiry_date", "admission_date"], ["enquiry_date", "joining_date"]],
    "gross_fee_collected": [["paid"]],
    "pending_fee": [["pending"]],
    "overdue_fee": [["pending"]],
    "average_fee_per_student": [["amount"]],
    "default_rate": [["pending"]],
    "collection_efficiency": [["paid", "amount"], ["amount", "pending"]],
    "dropout_rate": [["lifecycle_column"], ["completion_source"], ["cancel_marker"]],
    "completion_rate": [["lifecycle_column"], ["completion_source"]],
    "not_coming_rate": [["lifecycle_column"], ["completion_source"]],
    "churn_rate": [["completion_source", "course_duration", "joining_date"], ["completion_source", "course_duration", "admission_date"]],
    "repeat_enrollment_rate": [["repeat_person"]],
    "certificate_pending_rate": [["issue_date"]],
    "duplicate_certificate_rate": [["certificate_number"]],
    "certificate_issue_lag_days": [["issue_date", "joining_date"], ["issue_date", "admission_date"]],
}

# Who owns actions on a dimension, their category, what kinds of action take, and their horizon.
ACTION_OWNER = {"branch": "branch_manager", "source": "marketing_lead", "faculty": "academic_head", "course": "academics", "course_category": "academics", "pending": "accounts", "amount": "accounts", "paid": "accounts", "certificate": "operations"}
ACTION_CATEGORY = {"branch": "Branch Management", "source": "Marketing", "faculty": "Operations", "course": "Courses", "course_category": "Courses", "pending": "Finance", "amount": "Finance", "paid": "Revenue", "certificate": "Certificates", "review": "Student Experience"}
ACTION_EFFORT_RISK = {"close_gap": ("medium", "low"), "scale_lever": ("low", "low"), "investigate": ("low", "low"), "reduce_backlog": ("medium", "medium")}
ACTION_TIMELINE = {"low": "Short-Term (8-30 Days)", "medium": "Medium-Term (1-3 Months)", "high": "Long-Term (3+ Months)"}
