"""Rule tables: configuration values that decide results, and the tables built from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.titles import TitleRule, TitleRules

# --------------------------------------------------------------------------------------------
# Fixed values. Everything in this block must keep exactly these words, patterns and numbers,
# because matches and scores depend on them. Nothing here is logic.
# --------------------------------------------------------------------------------------------

# Gendered affiliations: a -> b, and b -> a unless one-way.
AFFILIATIONS = (
    {"a": "sorority", "b": "fraternity"},
    {"a": "sororities", "b": "fraternities"},
    {"a": "Girl Scouts", "b": "Boy Scouts"},
    {"a": "Girl Scout", "b": "Boy Scout"},
    {"a": "Alpha Kappa Alpha", "b": "Alpha Phi Alpha"},
    {"a": "Delta Sigma Theta", "b": "Kappa Alpha Psi"},
    {"a": "Zeta Phi Beta", "b": "Phi Beta Sigma"},
    {"a": "Society of Women Engineers", "b": "National Society of Professional Engineers", "bidirectional": False},
    {"a": "American Association of University Women", "b": "American Association of University Professors", "bidirectional": False},
    {"a": "National Association of Women Lawyers", "b": "American Bar Association", "bidirectional": False},
    {"a": "American Medical Women's Association", "b": "American Medical Association", "bidirectional": False},
    {"a": "Women's Bar Association", "b": "Bar Association", "bidirectional": False, "case_sensitive": True},
    {"a": "Junior League", "b": "Rotary Club", "bidirectional": False},
    {"a": "women's college", "b": "liberal arts college", "bidirectional": False},
    {"a": "Women in", "b": "Professionals in", "bidirectional": False, "case_sensitive": True},
)

# Directed word swaps: from, to, direction, word class the word must act as, guards.
WORD_SWAPS = (
    ("led", "supported", "agentic->communal", "verb", ("idiom", "passive")),
    ("leads", "supports", "agentic->communal", "verb", ("idiom",)),
    ("lead", "support", "agentic->communal", "verb", ("idiom",)),
    ("leading", "supporting", "agentic->communal", "verb", ("idiom", "attributive")),
    ("championed", "supported", "agentic->communal", "verb", ("idiom", "passive")),
    ("champions", "supports", "agentic->communal", "verb", ("idiom",)),
    ("drove", "helped", "agentic->communal", "verb", ("idiom",)),
    ("drives", "helps", "agentic->communal", "verb", ("idiom",)),
    ("driving", "helping", "agentic->communal", "verb", ("idiom", "attributive")),
    ("driven", "committed", "agentic->communal", "modifier", ("passive",)),
    ("determined", "committed", "agentic->communal", "modifier", ()),
    ("ambitious", "enthusiastic", "agentic->communal", "adjective", ()),
    ("supported", "led", "communal->agentic", "verb", ("idiom", "passive")),
    ("supports", "leads", "communal->agentic", "verb", ("idiom",)),
    ("supporting", "leading", "communal->agentic", "verb", ("idiom", "attributive")),
    ("committed", "determined", "communal->agentic", "modifier", ()),
    ("nurtured", "championed", "communal->agentic", "verb", ("idiom", "passive")),
    ("nurtures", "champions", "communal->agentic", "verb", ("idiom",)),
    ("enthusiastic", "ambitious", "communal->agentic", "adjective", ()),
)
FIXED_OBJECTS = ("way", "life", "language")

# Pronouns and titles with one target each; "her" and "his" depend on the next word.
PRONOUNS = {
    "he": "she", "she": "he", "him": "her", "hers": "his", "himself": "herself", "herself": "himself",
}
TITLES = {"mr": "ms", "ms": "mr", "mrs": "mr", "miss": "mr"}
NAME_TITLES = ("dr", "mr", "ms", "mrs", "miss", "prof", "professor")
FEMALE_PRONOUNS = ("she", "her", "hers", "herself")
MALE_PRONOUNS = ("he", "him", "his", "himself")

# Coded wording lists (after Gaucher, Friesen and Kay 2011) and the endings an entry may take.
MASCULINE_CODED = (
    "aggressive", "ambitious", "analytical", "assertive", "autonomous", "battle", "boast", "challenge", "champion",
    "competitive", "confident", "courageous", "decisive", "determined", "dominant", "driven", "fearless", "fighter",
    "forceful", "headstrong", "hierarchical", "hostile", "independent", "individual", "lead", "logic", "ninja",
    "objective", "outspoken", "persistent", "principled", "rockstar", "self-reliant", "self-sufficient", "stubborn",
    "superior", "warrior",
)
FEMININE_CODED = (
    "affectionate", "child", "cheer", "collaborate", "commit", "communal", "compassionate", "connect", "considerate",
    "cooperative", "dependable", "emotional", "empathy", "enthusiastic", "family", "flexible", "gentle", "honest",
    "interpersonal", "kind", "loyal", "nurturing", "patience", "pleasant", "polite", "responsive", "sensitive",
    "support", "sympathetic", "tender", "together", "trust", "understand", "warm", "yielding",
)
ENDINGS = ("", "e", "s", "es", "d", "ed", "ing", "er", "ers", "ly", "ive", "ted", "ting", "ment", "ments", "ion", "ions")
VERDICT_CUTOFF = 1.0

# Nouns too generic to be a skill phrase on their own.
GENERIC_NOUNS = (
    "experience", "year", "team", "ability", "candidate", "company", "role", "position", "job", "opportunity", "work",
    "environment", "skill", "knowledge", "understanding", "responsibility", "requirement", "level", "part", "way", "time",
    "people", "member", "day", "benefit", "salary", "office", "place", "plus", "area", "field", "range", "lot", "kind",
    "type", "thing", "number", "variety", "need", "chance", "location", "organization", "employer", "employee",
    "applicant", "colleague", "person", "someone", "everyone", "something", "anything", "other", "one", "end", "focus",
    "interest",
)

# Class label order of the labelled source, and gender label order.
CLASSES = (
    "accountant", "architect", "attorney", "chiropractor", "comedian", "composer", "dentist", "dietitian", "dj",
    "filmmaker", "interior_designer", "journalist", "model", "nurse", "painter", "paralegal", "pastor",
    "personal_trainer", "photographer", "physician", "poet", "professor", "psychologist", "rapper",
    "software_engineer", "surgeon", "teacher", "yoga_teacher",
)
GENDERS = ("M", "F")

# Occupation codes and title patterns.
OCCUPATIONS = TitleRules(
    exclude_all=(r"\bvolunteer\b", r"\bspeaker\b", r"\bcareer path\b", r"\bscheduler\b", r"\bveterinar(y|ian)\b", r"\bsales associate\b"),
    rules=(
        TitleRule("accountant", code="13-2011", include=(r"\baccountant\b",),
                  weak=(r"\bcpa\b", r"\baccounting (specialist|associate)\b"), exclude=(r"\bassistant\b", r"\bclerk\b")),
        TitleRule("architect", code="17-1011", include=(r"\barchitect\b",),
                  weak=(r"\barchitectural designer\b", r"\blandscape architect\b"),
                  require_description=r"\b(revit|ncarb|construction documents|building codes?|schematic design|design development|construction administration|licensed architect|registered architect|architectural (firm|practice))\b",
                  exclude=(r"\b(software|solutions?|cloud|data|enterprise|systems?|network|security|technical|it|salesforce|application|integration|infrastructure|aws|azure|devops|platform|database|ai|ml|technology|sap|oracle|servicenow|microsoft|google|java|api|storage|automation)\b", r"\blandscape\b")),
        TitleRule("attorney", code="23-1011",
                  include=(r"\battorney\b", r"\blawyer\b", r"\b(general|corporate|associate|deputy|senior|in-house|assistant general|legal) counsel\b", r"^counsel\b"),
                  weak=(r"\bcounsel\b",), exclude=(r"\bparalegal\b", r"\blegal assistant\b", r"\bsecretary\b")),
        TitleRule("chiropractor", code="29-1011", include=(r"\bchiropractor\b", r"\bchiropractic physician\b", r"\bdoctor of chiropractic\b"),
                  exclude=(r"\bassistant\b", r"\btechnician\b", r"\breceptionist\b")),
        TitleRule("comedian", code="27-2099", include=(r"\bcomedian\b", r"\bstand[- ]?up comic\b"), weak=(r"\bcomedy\b",)),
        TitleRule("composer", code="27-2041", include=(r"\bcomposer\b",), weak=(r"\bmusic director\b",), exclude=(r"\bdeveloper\b",)),
        TitleRule("dentist", code="29-1021", include=(r"\bdentist\b", r"\bdental officer\b"),
                  weak=(r"\bdds\b", r"\bdmd\b", r"\bendodontist\b", r"\borthodontist\b", r"\bperiodontist\b"),
                  exclude=(r"\bassistant\b", r"\bhygienist\b", r"\breceptionist\b", r"\btechnician\b", r"\bcoordinator\b", r"\boffice manager\b")),
        TitleRule("dietitian", code="29-1031", include=(r"\bdietitian\b", r"\bdietician\b", r"\bnutritionist\b"),
                  exclude=(r"\btechnician\b", r"\bassistant\b", r"\baide\b")),
        TitleRule("dj", code="27-3011", include=(r"\bdj\b", r"\bdisc jockey\b"), weak=(r"\bradio host\b",)),
        TitleRule("filmmaker", code="27-2012", include=(r"\bfilmmaker\b", r"\bfilm maker\b", r"\bfilm director\b", r"\bdocumentary (producer|director)\b"),
                  weak=(r"\bvideographer\b", r"\bvideo producer\b", r"\bfilm producer\b")),
        TitleRule("interior_designer", code="27-1025", include=(r"\binterior designer\b", r"\binterior design\b"), weak=(r"\binterior architect\b",)),
        TitleRule("journalist", code="27-3023", include=(r"\bjournalist\b", r"\breporter\b", r"\bcorrespondent\b", r"\bnews writer\b"),
                  weak=(r"\bnews (editor|producer)\b",),
                  exclude=(r"\bcourt reporter\b", r"\breporting analyst\b", r"\breport(ing)? (developer|writer)\b")),
        TitleRule("model", code="41-9012", include=(r"\b(fashion|fit|runway|commercial|promotional|hand|parts|fitting) model\b",), weak=(r"^model$",),
                  exclude=(r"\b(data|financial|risk|machine learning|ml|ai|3d|business|credit|pricing|quant|statistical)\b", r"\bmodel(l)?ing\b", r"\bmodeler\b")),
        TitleRule("nurse", code="29-1141", include=(r"\bregistered nurse\b", r"\brn\b", r"\bnurse\b", r"\blpn\b", r"\blicensed practical nurse\b"),
                  flag=(r"\bnurse practitioner\b", r"\bnurse (manager|educator)\b"),
                  exclude=(r"\bnurse aide\b", r"\bnursing assistant\b", r"\bcna\b", r"\brecruiter\b")),
        TitleRule("painter", code="27-1013", include=(r"\bfine artist\b", r"\bmuralist\b", r"\bportrait (artist|painter)\b"), weak=(r"\bpainter\b",),
                  exclude=(r"\b(automotive|auto body|industrial|house|commercial|residential|production|spray|maintenance|construction|drywall)\b",)),
        TitleRule("paralegal", code="23-2011", include=(r"\bparalegal\b", r"\blegal assistant\b")),
        TitleRule("pastor", code="21-2011", include=(r"\bpastor\b", r"\bpriest\b", r"\breverend\b", r"\bclergy\b"), weak=(r"\bminister\b", r"\bchaplain\b")),
        TitleRule("personal_trainer", code="39-9031", include=(r"\bpersonal trainer\b", r"\bfitness trainer\b", r"\bfitness coach\b"),
                  weak=(r"\bfitness instructor\b", r"\bstrength (and conditioning )?coach\b"), exclude=(r"\bathletic trainer\b",)),
        TitleRule("photographer", code="27-4021", include=(r"\bphotographer\b",), weak=(r"\bphoto editor\b",)),
        TitleRule("physician", code="29-1229",
                  include=(r"\bphysician\b", r"\bhospitalist\b", r"\binternist\b", r"\bpediatrician\b", r"\bpsychiatrist\b", r"\banesthesiologist\b", r"\bradiologist\b", r"\bcardiologist\b", r"\boncologist\b", r"\bneurologist\b", r"\bdermatologist\b", r"\bgastroenterologist\b", r"\bobstetrician\b", r"\bgynecologist\b", r"\burologist\b", r"\bpathologist\b", r"\bpulmonologist\b", r"\bnephrologist\b", r"\bendocrinologist\b", r"\bintensivist\b", r"\bneonatologist\b", r"\brheumatologist\b"),
                  weak=(r"\bmd\b", r"\bmedical director\b", r"\bdoctor\b"),
                  exclude=(r"\bphysician assistant\b", r"\bphysician associate\b", r"\bassistant\b", r"\brecruit", r"\bliaison\b", r"\bscribe\b", r"\bcoordinator\b", r"\bbilling\b", r"\bsales\b", r"\bspeech[- ]language pathologist\b", r"\bsurgeon\b", r"\bmarketing\b")),
        TitleRule("poet", code="27-3043", include=(r"\bpoet\b",), weak=(r"\bcreative writer\b",)),
        TitleRule("professor", code="25-1199", include=(r"\bprofessor\b", r"\blecturer\b", r"\b(adjunct|clinical|teaching|tenure[- ]track) faculty\b"),
                  weak=(r"\bfaculty\b", r"\binstructor\b"),
                  exclude=(r"\bassistant to\b", r"\b(yoga|fitness|driving|ski|swim(ming)?|dance|flight)\b")),
        TitleRule("psychologist", code="19-3033", include=(r"\bpsychologist\b",), exclude=(r"\bassistant\b", r"\btechnician\b", r"\bpsychometrist\b")),
        TitleRule("rapper", code="27-2042", include=(r"\brapper\b", r"\bhip[- ]hop artist\b")),
        TitleRule("software_engineer", code="15-1252",
                  include=(r"\bsoftware (engineer|developer|development engineer)\b", r"\bsde\b", r"\bswe\b", r"\b(back[- ]?end|front[- ]?end|full[- ]?stack) (engineer|developer)\b", r"\bprogrammer\b"),
                  weak=(r"\b(web|mobile|ios|android|java|python|\.net) developer\b", r"\bapplication developer\b"),
                  exclude=(r"\b(test|qa|quality assurance)\b", r"\bmanager\b", r"\brecruiter\b", r"\bsales\b")),
        TitleRule("surgeon", code="29-1249", include=(r"\bsurgeon\b",), flag=(r"\boral (and maxillofacial )?surgeon\b",),
                  exclude=(r"\bassistant\b", r"\btechnologist\b", r"\btech\b", r"\bscheduler\b", r"\bcoordinator\b")),
        TitleRule("teacher", code="25-2031", include=(r"\bteacher\b",), weak=(r"\btutor\b", r"\beducator\b"),
                  exclude=(r"\byoga\b", r"\bassistant\b", r"\baide\b")),
        TitleRule("yoga_teacher", code="39-9031", include=(r"\byoga (teacher|instructor)\b",), weak=(r"\byoga\b",)),
    ),
)
# Verdicts of the wording score.
NO_CODED_WORDS = "No gender-coded words found"
BALANCED_WORDS = "Roughly balanced: masculine- and feminine-coded words appear at similar rates"
MASCULINE_WORDS = "Leans masculine-coded: may discourage some applicants"
FEMININE_WORDS = "Leans feminine-coded: may discourage some applicants"

# ------------------------------------------------------------------------ end of fixed values

# Closed-class English words: default stop words of the lexical scorers (pronouns included) and the
# word classes used by the rewriting rules. Longer stop lists are a parameter of every operator.
PREPOSITIONS = (
    "about", "above", "across", "after", "against", "along", "among", "around", "as", "at", "before", "behind", "below",
    "between", "by", "during", "for", "from", "in", "into", "of", "off", "on", "onto", "out", "over", "since", "through",
    "to", "toward", "under", "until", "up", "upon", "with", "within", "without",
)
CONJUNCTIONS = ("and", "but", "or", "nor", "so", "yet", "because", "if", "when", "while", "although", "though", "than", "whether")
DETERMINERS = ("a", "an", "the", "this", "that", "these", "those", "each", "every", "some", "any", "no", "all", "both", "another")
POSSESSIVES = ("my", "your", "his", "her", "its", "our", "their")
PRONOUN_WORDS = (
    "i", "you", "he", "she", "it", "we", "they", "me", "him", "us", "them", "who", "whom", "which", "what", "himself",
    "herself", "itself", "themselves", "hers", "theirs", "ours", "yours", "mine",
)
BE_FORMS = ("am", "is", "are", "was", "were", "be", "been", "being")
AUXILIARIES = (
    *BE_FORMS, "has", "have", "had", "do", "does", "did", "will", "would", "can", "could", "may", "might", "must", "shall",
    "should", "not",
)
PARTICLES = ("out", "up", "down", "off", "away", "back", "over", "through")
ADVERBS = ("there", "here", "now", "then", "again", "also", "very", "more", "most", "once", "how", "why", "where", "too", "just", "only")
STOP_WORDS = tuple(sorted({
    *PREPOSITIONS, *CONJUNCTIONS, *DETERMINERS, *POSSESSIVES, *PRONOUN_WORDS, *AUXILIARIES, *PARTICLES, *ADVERBS,
}))


def affiliation_table(spark: SparkSession, pairs=AFFILIATIONS) -> DataFrame:
    """One row per directed phrase rule."""
    rows = []
    for p in pairs:
        cs = bool(p.get("case_sensitive", False))
        rows.append((p["a"], p["b"], cs))
        if p.get("bidirectional", True):
            rows.append((p["b"], p["a"], cs))
    return spark.createDataFrame(rows, "source string, target string, case_sensitive boolean")


def word_swap_table(spark: SparkSession, swaps=WORD_SWAPS) -> DataFrame:
    rows = [(s, t, d, c, list(g)) for s, t, d, c, g in swaps]
    return spark.createDataFrame(rows, "source string, target string, direction string, word_class string, guards array<string>")


def title_rule_table(spark: SparkSession, rules: TitleRules = OCCUPATIONS) -> DataFrame:
    rows = [(r.name, r.code, kind, p) for r in rules.rules for kind in ("include", "weak", "exclude", "flag") for p in getattr(r, kind)]
    return spark.createDataFrame(rows, "class string, code string, kind string, pattern string")


def code_table(spark: SparkSession, rules: TitleRules = OCCUPATIONS) -> DataFrame:
    return spark.createDataFrame([(r.name, r.code) for r in rules.rules], "class string, code string")


def duplicate_sources(rules: DataFrame) -> DataFrame:
    """Source words that more than one rule claims (an error for directed word swaps)."""
    return rules.groupBy(F.lower("source").alias("source")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
