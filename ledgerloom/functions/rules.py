"""Ordered regular-expression rules as columns: the first rule that matches names the result.

Java's classes are ASCII unless told otherwise, so every pattern is compiled with ``(?U)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = tuple[tuple[str, str], ...]

# Rule tables, in order of priority.
PII: Rules = (
    ("PAN", r"\b[A-Z]{5}\d{4}[A-Z]\b"),
    ("AADHAAR", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("ACCOUNT", r"(?i)\b(?:account|acc(?:ou)?nt|a/c)\b(?:\s*\b(?:no|number|#|is|was)\b|\s|[:.-]){0,3}\d{6,}\b"),
    ("OTP", r"(?i)\b(?:otp|one[\s-]?time\s+(?:password|code))\b(?:\s*\b(?:is|was)\b|\s|[:.-]){0,3}\d{4,6}\b"),
    ("CVV", r"(?i)\b(?:cvv|cvc|security\s+code)\b(?:\s*\b(?:is|was)\b|\s|[:.-]){0,3}\d{3,4}\b"),
    ("EMAIL", r"\b[\w.+-]+@[\w-]+\.[\w.-]{2,}\b"),
    ("PHONE", r"(?<!\d)(?:\+?91[\s.-]?)?[6-9]\d{4}[\s.-]?\d{5}(?!\d)"),
)
ADVICE: Rules = (
    ("SHOULD_I", r"(?i)\bshould\s+(?:i|we|one)\b"),
    ("BETTER_THAN", r"(?i)\b(better|preferable|more\s+suitable|suits\s+me)\b"),
    ("BEST", r"(?i)\b(best|top[\s-]performing|highest|optimal|winner)\b"),
    ("RECOMMEND", r"(?i)\b(recommend|suggest|advise|advice|opinion|thoughts)\b"),
    ("TIMING", r"(?i)\b(good|right|ideal)\s+time\b|\btime\s+to\s+(?:buy|sell|enter|exit|invest)\b"),
    ("PERSONAL_PLAN", r"(?i)\b(?:i'?m|i\s+am|aged?)\s+\d{2}\b|\b(earn|salary|income|saving)s?\b|\bwhere\s+should\s+i\b|\bhow\s+should\s+i\b|\bsplit\s+my\b"),
    ("PORTFOLIO", r"(?i)\b(portfolio|asset\s+allocation|allocation|rebalance|divider?|diversif\w*)\b"),
    ("RETURNS", r"(?i)\b(?:average|expected|annual(?:ised|ized)?|historical|projected|past|last|previous|overall)\s+return|\breturns?\s+(?:of|on)\s+\w|\bhow\s+(?:much|many)\b[^?]*\breturn|\bperformance\b|\bperformed?\b|\bprofitab\w*|\byield\b|\bgiven\s+the\s+(?:best|highest|most)\b|\bcompare\b[^?]*\breturns?\b|\breturns?\s+(?:been|are|was|were)\s+(?:the\s+)?(?:best|highest|worst|lowest)"),
    ("PROJECTION", r"(?i)\bhow\s+much\s+(?:will|can|could|should)\s+(?:i|we|one)\s+(?:make|earn|get|gain|profit|lose)\b|\bwhat\s+(?:will|would|could)\s+(?:be\s+the\s+returns?|i\s+get|my\s+returns?)\b|\bwill\s+(?:i|we)\s+(?:make|earn|profit)\b|\bhow\s+much\s+profit\b"),
    ("OPINION", r"(?i)\b(?:is|are)\b[^?]{0,40}\b(?:a\s+)?(?:good|bad|poor|great|safe|safer|risky|successful|profitable|worth|winning)\s+(?:fund|scheme|investment|option|choice|one)\b|\b(?:good|bad|safe|risky)\s+fund\b|\bis\s+[\w\s]{1,24}\s+(?:safe|safer|riskier|risky|less\s+risky|more\s+risky|volatile|stable)\b|\b(?:safer|riskier|more\s+risky|less\s+risky|volatile|safer)\s+than\b"),
)
OFF_TOPIC: Rules = (
    ("GREETING", r"(?i)^\s*(hi|hello|hey|yo|thanks|thank\s+you|thx|bye|goodbye|ok|okay|cool|got\s+it)\b[\s!.?]*$"),
    ("META", r"(?i)\b(who\s+are\s+you|what\s+(?:are|can)\s+you|your\s+name|are\s+you\s+(?:an?\s+)?(?:ai|robot|human)|how\s+do\s+you\s+work)\b"),
    ("OTHER_DOMAIN", r"(?i)\b(stock\s+price|share\s+price|bitcoin|crypto|nifty\s+fifty|gold\s+price|usd|inr\s+to\s+usd|weather|cricket|election|president)\b"),
    ("SENSITIVE", r"(?i)\b(loan|credit\s?card|insurance\s+plan|medic|legal\s+advice|which\s+job|real\s+estate)\b|\b(file|filing|file\s+my|submit|declare)\b[^?]*\b(tax|taxes|itr)\b"),
)
IN_SCOPE = r"(?i)\b(hdfc|mutual\s+fund|flexi\s*cap|mid[\s-]?cap|large[\s-]?cap|elss|tax\s+saver|scheme|amc|nav|expense\s+ratio|\ber\b|ter\b|exit\s+load|load\b|minimum|min\b|sip\b|lump|invest(?:ment)?\s+amount|aum\b|assets?\s+under\s+management|risk|riskometer|benchmark|index|lock[\s-]?in|holding\s+period|objective|fund\s+house|manager|tax\b|stamp\s+duty|plan\b|direct\b|regular\b|what|which|how\s+much|how\s+do|how\s+is|list|explain|difference|statement|document|prospectum|fact|detail|portfolio\s+construction)\b"
SCHEMES: Rules = (
    ("elss", r"(?i)\b(elss|tax\s+saver)\b"),
    ("flexi_cap", r"(?i)\bflexi\s*cap\b"),
    ("mid_cap", r"(?i)\bmid[\s-]?cap\b"),
    ("large_cap", r"(?i)\blarge\s*cap\b"),
)
AMC: Rules = (
    ("amc", r"(?i)\bhdfc\s+(?:mutual\s+funds?|mf)\b"),
    ("amc", r"(?i)\bthe\s+amc\b"),
    ("amc", r"(?i)\bfund\s+house\b"),
    ("amc", r"(?i)\basset\s+management\s+compan(?:y|ies)\b"),
    ("amc", r"(?i)\bsebi\s+(?:registration|registered)\b"),
)
DRIFT: Rules = (
    ("ADVICE", r"(?i)\b(you\s+should|you\s+ought|i\s+recommend|i\s+advise|we\s+recommend|it'?s\s+better|is\s+better\s+to|consider\s+investing|consider\s+buying|consider\s+selling|suitable\s+for\s+you|best\s+(?:fund|scheme|option|choice)|my\s+suggestion|tips?\s+for\s+investing)\b"),
    ("PERFORMANCE", r"(?i)\b(?:expected|average|annual(?:ised|ized)?|historical|projected|likely|potential)\s+(?:\w+\s+){0,2}returns?\b|\breturns?\s+(?:of|around|about|approximately|~)\s*\d|\bguaranteed?\b|\bpromises?\b|\bno\s+risk\b|\brisk[\s-]free\b|\bbeat(?:s)?\s+the\s+(?:market|index|nifty)\b|\boutperform\w*|\bbest\s+perform\w*|\btop\s+perform\w*"),
)
STANDALONE = r"(?i)\b(hdfc\b|mutual\s+fund|amc\b|sebi\b|scheme\b|flexi\s*cap|mid[\s-]?cap|large\s*cap|elss\b|tax\s+saver)\b"
DONT_KNOW = r"(?i)(?:i\s+(?:do\s+not|don'?t)\s+have\s+that\s+(?:information|data|answer)|(?:the\s+)?(?:context|source|pages?|information)\s+(?:does\s+not|doesn'?t|don'?t)\s+(?:contain|have|include|cover)|not\s+(?:available|covered|stated|present|mentioned)\s+in|not\s+(?:in|among)\s+(?:my\s+|the\s+)?(?:source|context|pages?))"
DANGLING = r"(?i)\s*\b(?:see|refer|refer to|reference|visit|source|sources|for\s+(?:more|details|further)|more\s+at|read\s+more|link|as\s+per|according\s+to|per)\b\s*[.:,-]?\s*$"
DROP_HEADINGS = ("return calculator", "returns calculator", "returns and rankings", "annualised returns", "absolute returns", "holdings", "compare similar funds", "view mutual funds from other amcs", "amc/fund houses", "fund categories", "why invest with groww", "how to invest in hdfc mf on groww", "duration", "risk")
DROP_LINE = r"(?i)annualized returns|annualised returns|\breturns?\s+for\s+the\s+past\b|^\s*historic returns"
JUNK_LINE = r"(?i)^(view all|see more|show more|load more|compare|add to watchlist|sign in|log in|login|menu|close|search|share|copy|download|apply now)\b\.?$"
STOP_AT = ("also manages these schemes", "check past data")
# What a user is told.
MESSAGES = {
    "pii": "I can't help with that - this assistant doesn't collect or store personal information, and I've not saved any part of your message.\n\nFor statements, address changes or tax documents, use the official logged-in portal or your registrar:",
    "advice": "I can share published facts about these funds, but I can't give investment advice, compare which one suits you, or comment on returns.\n\nThe facts themselves - expense ratio, exit load, minimum investment, risk level, benchmark - are on the source page:",
    "off_topic": "I can only answer factual questions about the HDFC funds in my corpus, which is drawn from the source page below.",
    "no_hint": "I can only answer questions about published facts for these funds - NAV, expense ratio, exit load, minimum investment, risk level, benchmark, lock-in and AMC details.",
    "drift": "I can only state published facts from the source pages, and I don't give recommendations. Here is the source to read the facts yourself:",
    "empty": "I couldn't produce a factual answer from the source pages. The facts are here:",
    "not_in_corpus": "I don't have that information in my source pages.",
    "blank": "Please type a question.",
    "no_key": "The model that writes answers isn't set up. These are the passages found.",
    "generation_error": "The model that writes answers gave none. These are the passages found.",
}


def java(pattern: str) -> str:
    """The pattern with Unicode classes and case rules."""
    return "(?U)" + pattern


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(java(pattern)), F.lit(False))


def first_match(text: Column, rules: Rules) -> Column:
    """Name of the first rule that matches; null for none and for null text."""
    return F.coalesce(*(F.when(matches(text, p), F.lit(n)) for n, p in rules))


def pii(text: Column) -> Column:
    return first_match(text, PII)


def scheme(text: Column) -> Column:
    return first_match(text, SCHEMES)


def target(text: Column) -> Column:
    """Which document a question is about: 'scheme:<name>', 'amc' or ''."""
    return F.coalesce(F.concat(F.lit("scheme:"), scheme(text)), first_match(text, AMC), F.lit(""))


def _decision(status: str, rule: Column, message: str, link: Column) -> Column:
    return F.struct(F.lit(status == "answered").alias("ok"), F.lit(status).alias("status"), F.lit(message).alias("message"), link.alias("link_scheme"), rule.alias("rule"))


def screen(question: Column) -> Column:
    """struct<ok, status, message, link_scheme, rule>: personal data first, then advice, then topics, then hints."""
    amc = F.lit("amc_overview")
    personal, advice, topic = pii(question), first_match(question, ADVICE), first_match(question, OFF_TOPIC)
    nothing = F.lit(None).cast("string")
    return (
        F.when(F.coalesce(F.trim(question), F.lit("")) == "", _decision("off_topic", nothing, MESSAGES["blank"], nothing))
        .when(personal.isNotNull(), _decision("refused_pii", F.concat(F.lit("pii:"), personal), MESSAGES["pii"], amc))
        .when(advice.isNotNull(), _decision("refused_advice", F.concat(F.lit("advice:"), advice), MESSAGES["advice"], F.coalesce(scheme(question), amc)))
        .when(topic.isNotNull(), _decision("off_topic", F.concat(F.lit("off_topic:"), topic), MESSAGES["off_topic"], amc))
        .when(matches(question, IN_SCOPE), _decision("answered", nothing, "", nothing))
        .otherwise(_decision("off_topic", F.lit("off_topic:no_hint"), MESSAGES["no_hint"], amc))
    )


def dropped_heading(heading: Column) -> Column:
    low = F.lower(heading)
    return reduce(lambda a, b: a | b, (low.startswith(x) for x in DROP_HEADINGS))
