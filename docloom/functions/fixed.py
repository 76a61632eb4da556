"""Word lists, patterns and weights that results depend on.

Patterns hold the characters themselves, so that Java's and RE2's syntax agree.
"""

# Scripts and marks.
ARABIC = "\u0600-\u06FF"
ARABIC_WIDE = "\u0600-\u06FF\u0750-\u077F\u08A0-\u08FF"
TOKEN = f"[a-z0-9]+|[{ARABIC_WIDE}]+"
TOKEN_EDGE = "^[؟،؛ـ]+|[؟،؛ـ]+$"
DIACRITICS = "[\u064B-\u065F\u0670\u06D6-\u06ED]"
EVAL_DIACRITICS = "[\u064B-\u065F\u0670]"
EVAL_TOKEN = f"[A-Za-z0-9_]+|[{ARABIC}]+"
WORD = r"[\p{L}\p{N}_]+"
YEAR = r"\b(19\d{2}|20\d{2})\b"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACE = r"[\s\x{A0}]"

# Stop words of the retrieval tokenizer.
STOPWORDS_EN = (
    "a an the and or but if then is are was were be been being of to in on at for with by as it "
    "this that these those from"
).split()
STOPWORDS_AR = (
    "من الى إلى على عن في و أو او ثم أن ان إن ما لا لم لن قد هذا هذه ذلك تلك هو هي هم التي "
    "الذي الذين بين مع كل بعد قبل حيث كما أي اي له لها لهم به بها منه منها"
).split()

# Heading patterns of scanned pages.
PAGE_PROCEDURE = (
    r"(?i)^\s*(?:[0-9٠-٩]+\s*[.)-]?\s*)?"
    r"(?:إجراءات|إجراء|الإجراءات|الإجراء|العملية|العمليات|المهمة|المهام)(?:[^\p{L}\p{N}_]|$)"
)
PAGE_NUMBERED = r"^\s*(?:[0-9٠-٩]{1,3}\s*[.)-])\s+[^.]{2,160}$"
PAGE_SECTION = (
    r"(?i)^(?:[0-9٠-٩]+\s*)?(?:مقدمة|التعريف|الهدف|النطاق|المسؤوليات|المسؤولية|السياسات|السياسة|"
    r"الإجراءات|المراجع|النماذج|التقارير|الملاحق|جدول التعديلات)(?:[^\p{L}\p{N}_]|$)"
)
PAGE_HEADING_WORDS = (
    "إدارة قسم سياسة دليل إجراءات إجراء تقرير النماذج التقارير المسؤوليات الهدف النطاق التعريف الملاحق المخزون"
).split()

# The line that starts a procedure.
PROCEDURE_START = (
    r"(?i)^\s*(?:"
    r"[.．]?\s*(?:\d+(?:\.\d+){0,3})\s*[-–—:.)]?\s*"
    r"(?:إجراءات|اجراءات|إجراء|اجراء|procedure|procedures|process|task)(?:\s+.*)?"
    r"|(?:procedure|process|task)\s*[:#\-]?\s*\d+(?:\.\d+)*.*"
    r"|(?:الإجراء|الإجراءات|العملية|المهمة)\s*[:#\-]?\s*.*"
    r")$"
)

# A table's title by words that it holds, the first rule that fits.
TABLE_TITLES = (
    (("المخزون الراكد", "المواد الراكدة"), "إجراءات المخزون الراكد من اللوازم والقرطاسية"),
    (("اسم النموذج", "مذكرة اعتماد"), "النماذج"),
    (("آلية استخراج التقرير", "الغاية من التقرير"), "التقارير"),
    (("أسباب التعديل", "الجهة طالبة التعديل"), "جدول التعديلات"),
    (("ملحق", "القيود المحاسبية"), "الملاحق"),
)

# Separators of the recursive splitter.
SEPARATORS = ("\n\n", "\n", "۔ ", ". ", "؟ ", "? ", "، ", ", ", " ", "")

# The router's markers, looked for as substrings.
MULTI_PART = (
    "ومن", "وكيف", "وما", "ومتى", "وأين", "ولماذا", "وهل", "وكم",
    "و من", "و كيف", "و ما", "و متى", "و أين", "و لماذا", "و هل", "و كم",
    " and what ", " and who ", " and how ", " and when ", " and where ", " and why ", " and does ", " and is ",
)
CONDITIONAL = ("إذا", "إذا ما", "لو", "في حال", "في حالة", "ماذا لو", "if ", "in case", "what if")
EXCEPTION = (
    "لم يمكن", "لم تتمكن", "لم يتم", "تعذر", "تعذّر", "عدم إمكانية", "عدم امكانية", "عدم القدرة",
    "البديل", "بديل", "الحل البديل", "cannot", "can not", "could not", "not possible", "unable to", "alternative",
)
DOCUMENT_SENSITIVE = (
    "formula", "calculate", "calculation", "equation", "procedure", "procedures", "process", "policy", "policies",
    "rule", "rules", "instruction", "instructions", "manual", "according to", "according to the manual",
    "according to the document", "how is", "how are", "what is the procedure", "what is the process",
    "reorder point", "minimum stock", "maximum stock", "safety stock", "inventory replenishment",
    "معادلة", "حساب", "طريقة الحساب", "كيفية الحساب", "إجراء", "إجراءات", "عملية", "قاعدة", "قواعد", "تعليمات",
    "الدليل", "الوثيقة", "حسب الدليل", "وفقا للدليل", "حد الطلب", "الحد الأدنى", "الحد الأقصى", "المخزون", "إعادة الطلب",
)
FALLBACK_COMPARE = ("compare", "advantages", "disadvantages", "and explain", "multiple")
FALLBACK_DATE = ("after 2024", "before ", "published", "year", "date")
FALLBACK_VAGUE = ("why is it bad", "what does it refer", "this", "that")
FALLBACK_FOCUSED = ("what is", "define", "why", "how")
TECHNIQUES = ("rewriting", "multi_query", "decomposition", "hyde", "self_query", "reranking", "compression", "crag")

# Terms and weights of the reranker.
RERANK_TERMS = (
    "حد الطلب", "الحد الأدنى", "الحد الأقصى", "المخزون", "إعادة الطلب", "الاستهلاك", "مدة المادة", "معادلة", "حساب",
    "المخزون الراكد", "راكد", "مستودع", "مستودعات", "stagnant", "warehouse", "material", "manual", "procedure",
)
RERANK_PHRASES = ("المخزون الراكد", "حد الطلب", "الحد الأدنى", "الحد الأقصى", "إعادة الطلب")
FORMULA = r"\p{Nd}[\s\x{A0}]*[=×÷+\-][\s\x{A0}]*\p{Nd}"
FORMULA_TERMS = ("معادلة", "حد الطلب")
EVIDENCE_TERMS = ("=", "×", "÷", "معادلة", "حد الطلب")
BONUS = {"table": 0.04, "formula": 0.10, "keyword_step": 0.02, "keyword_max": 0.08, "phrase": 0.08, "multi_step": 0.02, "multi_max": 0.08}
RERANK_WEIGHTS = {"pair": 0.74, "retrieval": 0.07, "lexical": 0.11}
CONFIDENCE_WEIGHTS = {"top": 0.55, "average": 0.20, "margin": 0.10, "agreement": 0.15}
CONFIDENCE_LABELS = ((0.80, "Very High"), (0.65, "High"), (0.45, "Medium"), (0.25, "Low"))

# Metadata that a filter may name.
FILTER_FIELDS = (
    "document", "procedure", "section", "version", "issue_date", "issue_year", "review_date", "review_year",
    "department", "year_gt",
)
YEAR_FIELDS = ("issue_year", "review_year", "year_gt")

# Prices in USD for a million tokens, input and output.
SIMULATED_PRICES = {
    "gemini-2.5-flash": (0.10, 0.40),
    "gemini-3.5-flash-lite": (0.30, 2.50),
    "gemini-3.5-flash": (1.50, 9.00),
    "qwen3-max": (1.20, 6.00),
    "qwen-plus": (0.40, 1.20),
    "qwen-turbo": (0.05, 0.20),
}
SIMULATED_DEFAULT = (0.10, 0.40)
ACTUAL_PRICES = {
    "gemini-3.5-flash-lite": (0.30, 2.50),
    "gemini-3.5-flash": (1.50, 9.00),
    "gemini-2.5-flash-lite": (0.10, 0.40),
}
ACTUAL_DEFAULT = (0.30, 2.50)
STEP_TECHNIQUE = {"router": "routing", "rewriter": "rewriting"}

# Phrases of answers and context blocks.
NO_CONTEXT = "(No relevant context was retrieved for this question.)"
NOT_FOUND = "I couldn't find that in the provided documents."
MOCK_PREFIX = "Based on the retrieved context, the relevant evidence is: "
MOCK_SUFFIX = " [MockLLMClient]"
TABLE_NOTE = "IMPORTANT: Preserve the relationship between table labels, rows, columns, values, and formulas."
BLOCK_SEPARATOR = "\n\n---\n\n"
