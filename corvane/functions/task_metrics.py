"""Task-specific quality metrics of a response, one rule per metric.

Every rule takes a dialect and returns SQL over the prepared columns:
``r0`` response, ``r`` stripped, ``rl`` stripped lower case, ``ru`` lower case,
``e0``, ``e``, ``el`` likewise for the expected output, ``qv`` question values;
and over what the rules of its module share, which is made once a row.
Failed generations and null responses score 0 (see ``evaluate``); rules marked
``needs_expected`` also score 0 for a null expected output.
"""

from __future__ import annotations

from collections.abc import Callable

from .dialect import Dialect

Rule = Callable[[Dialect], str]
#: (module, metric) to (rule, needs the expected output).
RULES: dict[tuple[str, str], tuple[Rule, bool]] = {}


def named(module: str, metric: str, needs_expected: bool = False):
    def add(f: Rule) -> Rule:
        RULES[module, metric] = (f, needs_expected)
        return f

    return add


Stages = Callable[[Dialect], list[dict[str, str]]]
#: Columns that the rules of a module share, stage by stage; a stage reads those before it.
SHARED: dict[str, Stages] = {}


def shared(module: str):
    def add(f: Stages) -> Stages:
        SHARED[module] = f
        return f

    return add


# ---- choice among given answers -------------------------------------------------------------

# Answer announcements.
CHOICE_ANSWER = [
    r"""answer[:\s]+['"]?([^'"\n]+)['"]?""",
    r"""best\s+(?:answer|choice)\s+is[:\s]+['"]?([^'"\n]+)['"]?""",
    r"""the\s+answer\s+should\s+be[:\s]+['"]?([^'"\n]+)['"]?""",
]
CHAT_PHRASES = ["let me know", "have a great day", "feel free", "i can help", "if you need", "just let me know", "best regards", "thank you"]
EXPLAINING = ["reasoning", "because", "explanation", "let me explain", "the reason", "this is because"]


@named("cose_choice", "answer_correctness", True)
def _(d: Dialect) -> str:
    def announced(p: str) -> str:
        x = d.strip(d.first("rl", p))
        return f"({d.matches('rl', p)} AND (contains({x}, el) OR contains(el, {x})))"

    hit = " OR ".join(["contains(rl, el)", *map(announced, CHOICE_ANSWER)])
    return d.weight(f"r <> '' AND e <> '' AND ({hit})", 1.0)


@named("cose_choice", "response_conciseness")
def _(d: Dialect) -> str:
    return d.when("r = ''", d.num(0.0), d.ladder("length(r)", [(20, 1.0), (50, 0.8), (200, 0.5), (500, 0.2)], 0.0))


def line_counts(d: Dialect) -> list[dict[str, str]]:
    lines = d.lines("r")
    return [{"n_lines": d.size(lines), "stripped": d.map(lines, d.strip)}, {"n_unique": d.size(d.distinct(d.filter("stripped", lambda x: f"{x} <> ''")))}]


def looping_lines(d: Dialect, more_than: int) -> str:
    """Many lines of which less than a third differ."""
    return f"(n_lines > {more_than} AND 3 * n_unique < n_lines)"


@shared("cose_choice")
def _(d: Dialect) -> list[dict[str, str]]:
    return [{"said": d.sort(d.sentences("rl", 10))}, *line_counts(d)]


@named("cose_choice", "instruction_following_penalty")
def _(d: Dialect) -> str:
    parts = d.split("r", "[.!?]+")
    loops = f"{d.size(parts)} > 10 AND {d.repeated('said', 3)}"
    lost = [
        d.weight(d.any_sub("rl", CHAT_PHRASES), 0.3),
        d.weight(f"{d.occurrences('r', 'Question:')} > 1", 0.2),
        d.weight(f"{d.count_sub('rl', EXPLAINING)} >= 2", 0.2),
        d.weight(looping_lines(d, 20), 0.5),
        d.weight(loops, 0.5),
    ]
    return d.when("r = ''", d.num(0.0), d.floor0(f"{d.num(1.0)} - " + " - ".join(lost)))


# ---- explanation of a choice ------------------------------------------------------------------

# Announcements, reasoning words and closing phrases.
EXPLAINED_ANSWER = [
    r"""correct\s+(?:answer|choice)\s+is\s+["']?([^"',.!\n]+)["']?""",
    r"""answer:\s*["']?([^"',.!\n]+)["']?""",
    r"""best\s+answer\s+is\s+["']?([^"',.!\n]+)["']?""",
    r"""the\s+answer\s+is\s+["']?([^"',.!\n]+)["']?""",
]
REASONING = ["because", "since", "as", "due to", "reason", "why", "therefore", "thus", "so", "which", "that is why", "this is because", "the reason", "can be", "would be", "typically", "often", "usually", "commonly", "likely"]
FLUFF = ["let me know if you need anything else", "please let me know", "have a great day", "feel free to", "i can help with", "just let me know"]


@shared("cose_explanation")
def _(d: Dialect) -> list[dict[str, str]]:
    stated = "CASE " + " ".join(f"WHEN {d.matches('rl', p)} THEN {d.strip(d.first('rl', p))}" for p in EXPLAINED_ANSWER) + " END"
    early = d.at(d.filter("choices", lambda x: f"contains(substr(rl, 1, 200), {x})"), 0)
    late = d.at(d.filter("choices", lambda x: f"contains(rl, {x})"), 0)
    told = f"coalesce(nullif({stated}, ''), nullif({early}, ''), nullif({late}, ''))"
    return [{"choices": d.map(d.literal_list(d.at("qv", 1)), lambda x: f"lower({x})"), "said": d.sort(d.sentences("rl", 10))}, {"told": told}, *line_counts(d)]


@named("cose_explanation", "answer_identification_correctness", True)
def _(d: Dialect) -> str:
    sure = d.filter("choices", lambda x: f"contains(el, {x}) AND (contains(told, {x}) OR contains({x}, told))")
    valid = d.filter("choices", lambda x: f"contains(told, {x}) OR contains({x}, told)")
    score = f"CASE WHEN told IS NULL THEN {d.num(0.0)} WHEN {d.size(sure)} > 0 THEN {d.num(1.0)} WHEN {d.size(valid)} > 0 THEN {d.num(0.5)} ELSE {d.num(0.0)} END"
    return d.when(f"r = '' OR e = '' OR {d.size('qv')} < 2", d.num(0.0), score)


@named("cose_explanation", "explanation_quality")
def _(d: Dialect) -> str:
    ladder = d.ladder("length(r)", [(300, 1.0), (500, 0.8), (800, 0.6), (1500, 0.3)], 0.0)
    return d.when(f"{d.any_sub('rl', REASONING)} AND length(r) >= 50", ladder, d.num(0.0))


@named("cose_explanation", "response_cleanliness")
def _(d: Dialect) -> str:
    n = d.size("said")
    asked = d.occurrences("r", "Question:")
    fluff = d.count_sub("rl", FLUFF)
    lost = [
        f"CASE WHEN {n} > 5 AND {d.repeated('said', 3)} THEN {d.num(0.5)} WHEN {n} > 10 AND {d.repeated('said', 2)} THEN {d.num(0.3)} ELSE {d.num(0.0)} END",
        d.weight(looping_lines(d, 15), 0.5),
        d.ladder(asked, [(2, 0.3), (1, 0.15)], 0.0, ">"),
        d.ladder(fluff, [(3, 0.2), (2, 0.1)], 0.0, ">="),
    ]
    return d.when("r = ''", d.num(0.0), d.floor0(f"{d.num(1.0)} - " + " - ".join(lost)))


# ---- justification of a given answer -----------------------------------------------------------

# Reasoning words, phrases about the answer and signs of other content.
JUSTIFYING = ["because", "since", "as", "due to", "reason", "why", "therefore", "thus", "so", "which means", "indicates", "implies", "suggests", "shows", "demonstrates", "typically", "often", "usually", "commonly", "can be", "would be", "is used", "refers to", "means that"]
STEPS = [r"##\s*step\s*\d+", r"step\s*\d+:", "the final answer is:"]
META = ["the best answer is", "the correct answer is", "answer is:"]
UNRELATED = ["let me know if you want", "another question:", r"what.+\?.*\?", "i can generate", "would you like me to"]


@shared("cose_justification")
def _(d: Dialect) -> list[dict[str, str]]:
    return [{"said": d.sort(d.sentences("rl", 15)), "n_said": d.size(d.sentences("r", 10))}]


@named("cose_justification", "explanation_correctness")
def _(d: Dialect) -> str:
    long_words = lambda s: d.every(s, r"\w{4,}")
    asked = d.joint(long_words(f"lower({d.at('qv', 0)})"), long_words(f"lower({d.at('qv', 1)})"))
    shared = f"CASE WHEN {d.size('qv')} >= 2 THEN {d.says_one('rl', asked)} ELSE FALSE END"
    return f"CASE WHEN NOT {d.any_sub('rl', JUSTIFYING)} THEN {d.num(0.0)} WHEN length(r) < 20 THEN {d.num(0.3)} WHEN {shared} THEN {d.num(1.0)} ELSE {d.num(0.7)} END"


@named("cose_justification", "brevity_compliance")
def _(d: Dialect) -> str:
    n = "n_said"
    steps = [("2", "length(r) BETWEEN 50 AND 200", 1.0), ("3", "length(r) <= 400", 0.8), ("5", "length(r) <= 600", 0.5), ("10", "length(r) <= 1000", 0.2)]
    cases = " ".join(f"WHEN {n} <= {k} AND {size} THEN {d.num(v)}" for k, size, v in steps)
    return f"CASE WHEN r = '' THEN {d.num(0.0)} {cases} ELSE {d.num(0.0)} END"


@named("cose_justification", "format_cleanliness")
def _(d: Dialect) -> str:
    lost = [
        d.weight(d.any_match("rl", STEPS), 0.2),
        d.weight(f"{d.count_sub('rl', META)} >= 2", 0.2),
        d.weight(d.any_match("rl", UNRELATED), 0.3),
        f"CASE WHEN {d.size('said')} <= 5 THEN {d.num(0.0)} WHEN {d.repeated('said', 3)} THEN {d.num(0.5)} WHEN {d.repeated('said', 2)} THEN {d.num(0.3)} ELSE {d.num(0.0)} END",
    ]
    return d.when("r = ''", d.num(0.0), d.floor0(f"{d.num(1.0)} - " + " - ".join(lost)))


# ---- choice between two hypotheses -------------------------------------------------------------

# How a hypothesis is named.
NAMED_HYPOTHESIS = r"hypothesis\s*[:\-]?\s*([01])"
STATED_HYPOTHESIS = r"(?:correct|answer|select|choose)(?:\s+hypothesis)?(?:\s+is)?[:\s]+([01])"
LONE_DIGIT = r"(?:^|[^0-9])([01])(?:[^0-9]|$)"
EXPLICIT_HYPOTHESIS = [r"(?:correct|answer|select)\s+(?:hypothesis\s+)?(?:is\s+)?", "^[01]$"]


def hypothesis(d: Dialect, low: str, raw: str) -> str:
    """0 or 1 as text; null if none is named."""
    return f"CASE WHEN {d.matches(low, NAMED_HYPOTHESIS)} THEN {d.first(low, NAMED_HYPOTHESIS)} WHEN {d.matches(low, STATED_HYPOTHESIS)} THEN {d.first(low, STATED_HYPOTHESIS)} WHEN {d.matches(raw, LONE_DIGIT)} THEN {d.first(raw, LONE_DIGIT)} END"


@shared("ecare_choice")
def _(d: Dialect) -> list[dict[str, str]]:
    return [{"told_raw": hypothesis(d, "ru", "r0"), "told": hypothesis(d, "rl", "r")}]


@named("ecare_choice", "answer_correctness", True)
def _(d: Dialect) -> str:
    return d.weight("coalesce(told_raw, '') = e AND told_raw IS NOT NULL", 1.0)


@named("ecare_choice", "follows_format_instruction")
def _(d: Dialect) -> str:
    return f"CASE WHEN told IS NULL THEN {d.num(0.0)} WHEN r IN ('0', '1') THEN {d.num(1.0)} ELSE {d.ladder('length(r)', [(15, 0.8), (100, 0.5)], 0.2)} END"


@named("ecare_choice", "answer_extractability")
def _(d: Dialect) -> str:
    def place(digit: str) -> str:
        by_name, alone = NAMED_HYPOTHESIS.replace("([01])", digit), LONE_DIGIT.replace("([01])", digit)
        return f"CASE WHEN {d.matches('rl', by_name)} THEN {d.position('rl', by_name)} WHEN {d.matches('rl', alone)} THEN {d.position('rl', alone)} ELSE length(r) END"

    at = f"(CASE WHEN told = '0' THEN {place('0')} ELSE {place('1')} END)"
    score = d.ladder(f"{at} / {d.num(1.0)} / length(r)", [(0.1, 1.0), (0.3, 0.8), (0.5, 0.6)], 0.4)
    both = f"{d.matches('rl', NAMED_HYPOTHESIS.replace('([01])', '0'))} AND {d.matches('rl', NAMED_HYPOTHESIS.replace('([01])', '1'))}"
    return f"CASE WHEN told IS NULL THEN {d.num(0.0)} WHEN {both} THEN {score} * {d.num(0.3)} WHEN {d.any_match('rl', EXPLICIT_HYPOTHESIS)} THEN least({score} + {d.num(0.2)}, {d.num(1.0)}) ELSE {score} END"


# ---- conceptual explanation ---------------------------------------------------------------------

# Signs of a specific rather than a conceptual text, with what they cost.
SPECIFIC = [
    (r"^\d+\.", 0.3),
    (r"\n\s*\d+\.", 0.3),
    (r"^\*\*", 0.2),
    (r"""here's|here is""", 0.2),
    (r"\bhe\b|\bshe\b|\bhis\b|\bher\b", 0.15),
    (r"\btom\b|\bmario\b|\bfisherman\b|\bsoldier\b", 0.25),
    (r"\bthis case\b|\bthis scenario\b|\bthis situation\b", 0.2),
    ("first|second|third|finally", 0.2),
    (r"step\s*\d+|stage\s*\d+", 0.2),
    (r"\(\d{4}\)", 0.3),
    ("references:|works cited:", 0.4),
    (r"et al\.", 0.3),
]
CONCEPTUAL = [r"\bare\b.*\ba\b", r"\bis\b.*\ba\b", "is defined as", "refers to", "means that", "represents"]
ABBREVIATIONS = r"(?i)\be\.g\.|\bi\.e\.|\bvs\.|\bdr\.|\bmr\.|\bms\.|\betc\."


@named("ecare_explanation", "response_brevity", True)
def _(d: Dialect) -> str:
    return d.ladder(d.size(d.words("r")), [(4, 0.0), (25, 1.0), (50, 0.8), (100, 0.5), (200, 0.3), (400, 0.1)], 0.0)


@named("ecare_explanation", "conceptual_abstraction_level")
def _(d: Dialect) -> str:
    lost = " + ".join(d.weight(d.matches("rl", p), v) for p, v in SPECIFIC)
    return d.clamp(f"{d.num(1.0)} - least({lost}, {d.num(1.0)}) + {d.weight(d.any_match('rl', CONCEPTUAL), 0.2)}")


@named("ecare_explanation", "single_sentence_format")
def _(d: Dialect) -> str:
    ends = d.size(d.every(d.replace("r", ABBREVIATIONS, ""), "[.!?]+"))
    breaks = d.size(d.every("r", r"\n\s*\n"))
    return d.ladder(f"({ends} + 3 * {breaks})", [(1, 1.0), (2, 0.8), (3, 0.6), (5, 0.4), (10, 0.2)], 0.0)


# ---- five-way choice -----------------------------------------------------------------------------

# Answers in quotes, answers without, and announcements.
QUOTED_CHOICE = [
    r"""(?:choice|answer|select|option)\s+is[:\s]+["']([^"']+)["']""",
    r"""(?:single\s+best\s+)?choice\s+is[:\s]+["']([^"']+)["']""",
    r"""best\s+choice[:\s]+["']([^"']+)["']""",
]
PLAIN_CHOICE = [
    r"(?:single\s+best\s+)?choice\s+is[:\s]+([a-z\s]+?)(?:\.|,|\n|$)",
    r"(?:correct\s+)?answer\s+is[:\s]+([a-z\s]+?)(?:\.|,|\n|$)",
    r"best\s+choice[:\s]+([a-z\s]+?)(?:\.|,|\n|$)",
]
TRAILING_REASON = r"\s+(because|as|since|that).*$"
SHORT_QUOTE = r"""["']([^"']{1,30})["']"""
EXPLICIT_CHOICE = [r"(?:the\s+)?(?:single\s+best\s+)?choice\s+is", r"(?:the\s+)?(?:correct\s+)?answer\s+is", r"best\s+choice(?:\s+based)?"]


def choices(d: Dialect) -> str:
    """The question values after the question, and after a short topic before it; empty if there are none."""
    words = lambda i: d.size(d.words(d.at("qv", i)))
    return f"CASE WHEN {d.size('qv')} > 2 AND {words(0)} <= 5 AND {words(1)} > 5 THEN {d.part('qv', 2)} ELSE {d.part('qv', 1)} END"


def plain_answers(d: Dialect, low: str, tag: str) -> dict[str, str]:
    """What follows each plain announcement, without a trailing reason; null where there is none."""
    return {f"{tag}{i}": f"CASE WHEN {d.matches(low, p)} THEN {d.replace(d.strip(d.first(low, p)), TRAILING_REASON, '')} END" for i, p in enumerate(PLAIN_CHOICE)}


def chosen(d: Dialect, raw: str, low: str, tag: str) -> str:
    """The answer that a text gives; null if none is found. Quoted answers first, then plain, listed and short quoted ones."""
    tries = [f"WHEN {d.matches(low, p)} THEN {d.strip(d.first(low, p))}" for p in QUOTED_CHOICE]
    tries += [f"WHEN length({x}) > 0 AND {d.size(d.words(x))} <= 5 THEN {x}" for x in plain_answers(d, low, tag)]
    listed = d.at(d.filter("offered", lambda x: d.has_word(low, x)), 0)
    quoted = d.at(d.filter(d.every(raw, SHORT_QUOTE, 1), lambda x: f"{d.size(d.words(x))} BETWEEN 1 AND 5"), 0)
    return f"CASE {' '.join(tries)} WHEN {raw} = '' THEN NULL ELSE coalesce({listed}, {d.strip(f'lower({quoted})')}) END"


@shared("ecqa_choice")
def _(d: Dialect) -> list[dict[str, str]]:
    low = lambda s: d.strip(f"lower({s})")
    return [
        {"low0": low("r0"), "low": low("r"), "choices": choices(d)},
        {"offered": d.map("choices", low), **plain_answers(d, "low0", "raw"), **plain_answers(d, "low", "plain")},
        {"told0": chosen(d, "r0", "low0", "raw"), "told": chosen(d, "r", "low", "plain"), "n_named": d.size(d.filter("offered", lambda x: d.has_word("rl", x)))},
    ]


@named("ecqa_choice", "answer_correctness", True)
def _(d: Dialect) -> str:
    bare = lambda s: d.strip(d.replace(s, r"[^\w\s]", ""))
    same = f"contains(told0, el) OR contains(el, told0) OR {bare('told0')} = {bare('el')}"
    return d.weight(f"told0 IS NOT NULL AND ({same})", 1.0)


@named("ecqa_choice", "follows_format_instruction")
def _(d: Dialect) -> str:
    return d.when("told IS NULL", d.num(0.0), d.ladder("length(r)", [(15, 1.0), (50, 0.8), (150, 0.5), (300, 0.3)], 0.1))


@named("ecqa_choice", "answer_extractability")
def _(d: Dialect) -> str:
    at = f"CASE WHEN contains(rl, told) THEN {d.find('rl', 'told')} ELSE floor(length(r) / 2) END"
    score = d.ladder(f"({at}) / {d.num(1.0)} / length(r)", [(0.1, 1.0), (0.25, 0.9), (0.5, 0.7)], 0.5)
    score = d.when(d.any_match("rl", EXPLICIT_CHOICE), f"least({score} + {d.num(0.1)}, {d.num(1.0)})", score)
    return d.when("told IS NULL", d.num(0.0), f"({score}) * {d.when('n_named > 2', d.num(0.7), d.num(1.0))}")


# ---- free explanation of all choices ---------------------------------------------------------------

# List markers and the keyword lists of depth.
LIST_MARKS = [r"(?m)^\s*[-•*]\s+", r"(?m)^\s*\d+[\.)]\s+"]
DEPTH = [
    (["because", "as", "since", "therefore", "thus", "hence", "this is why", "the reason", "due to", "given that", "consequently", "as a result"], 0.1, 0.35),
    (["leads to", "results in", "causes", "allows", "enables", "makes", "provides", "demonstrates", "shows", "indicates", "suggests", "implies", "means that"], 0.08, 0.25),
    (["unlike", "whereas", "while", "in contrast", "however", "on the other hand", "conversely", "instead", "rather than", "compared to", "different from", "similar to"], 0.1, 0.2),
    (["typically", "generally", "commonly", "usually", "often", "universally", "naturally", "inherently", "fundamentally", "by definition", "in practice", "historically", "traditionally"], 0.1, 0.2),
]
SHALLOW = [r"is\s+(not\s+)?correct", r"is\s+(not\s+)?the\s+answer", r"""(doesn't|does\s+not)\s+make\s+sense""", r"is\s+(too\s+)?(vague|specific|general)"]


@named("ecqa_freeflow", "all_choices_addressed")
def _(d: Dialect) -> str:
    offered = d.map(d.part("qv", 1, 1), lambda x: d.strip(f"lower({x})"))
    quoted = lambda x: " OR ".join(f"contains(ru, concat({d.lit(a)}, {x}, {d.lit(b)}))" for a in "\"'" for b in "\"'")
    met = d.size(d.filter(offered, lambda x: d.if_held("ru", x, f"{d.has_word('ru', x)} OR {quoted(x)}")))
    return d.when(f"{d.size('qv')} < 3", d.num(0.0), f"{met} / {d.num(1.0)} / ({d.size('qv')} - 2)")


@named("ecqa_freeflow", "single_paragraph_format")
def _(d: Dialect) -> str:
    capital = d.filter(d.part(d.lines("even"), 1), lambda x: d.matches(d.strip(x), r"^\p{Lu}"))
    blank_lines = d.size(d.every("even", r"\n\s*\n"))
    breaks = f"({blank_lines} + floor({d.size(capital)} / 2))"
    return d.when(f"r = '' OR {d.any_match('r', LIST_MARKS)}", d.num(0.0), d.ladder(breaks, [(0, 1.0), (1, 0.7), (2, 0.4)], 0.2))


def asked_words(d: Dialect) -> str:
    """Distinct lower-case words of five characters or more of the question."""
    return d.distinct(d.filter(d.words(f"lower({d.at('qv', 0)})"), lambda x: f"length({x}) >= 5"))


@shared("ecqa_freeflow")
def _(d: Dialect) -> list[dict[str, str]]:
    again = f"{d.size(d.filter('said', lambda x: d.holds('asked', x)))} / {d.num(1.0)} / greatest(1, {d.size('said')})"
    return [{"said": d.words("ru"), "asked": asked_words(d), "even": d.squeezed("r")}, {"again": again}]


@named("ecqa_freeflow", "explanation_depth")
def _(d: Dialect) -> str:
    gained = " + ".join(f"least({d.count_sub('ru', words)} * {d.num(each)}, {d.num(most)})" for words, each, most in DEPTH)
    lost = d.when(f"{d.size('qv')} > 0 AND again > 0.3", f"least(again - {d.num(0.3)}, {d.num(0.3)})", d.num(0.0))
    return d.when("ru = ''", d.num(0.0), d.clamp(f"{gained} - {lost} - {d.weight(f'{d.count_match("ru", SHALLOW)} > 3', 0.2)}"))


# ---- why the other choices are wrong ------------------------------------------------------------

# Conjunctions of complex sentences, signs of knowledge, forms of definitions.
CONJUNCTIONS = [r"\band\b", r"\bbut\b", r"\bwhile\b", r"\bwhereas\b", r"\balthough\b", r"\bthough\b", r"\bhowever\b", r"\bsince\b", r"\bbecause\b.*\band\b", r"\bif\b.*\bthen\b", r"\beither\b.*\bor\b"]
KNOWLEDGE = [r"is a\b", r"are\b", r"means\b", r"refers to\b", r"typically\b", r"usually\b", r"generally\b", r"often\b", r"is defined as\b", r"known for\b", r"characterized by\b", r"involves\b", r"requires\b", r"consists of\b"]
DEFINITIONS = [r"\b\w+\s+is\s+a\s+\w+", r"\b\w+\s+are\s+\w+", r"\b\w+\s+means\s+", r"\b\w+\s+refers\s+to\s+"]


def choices_by_worth(d: Dialect) -> list[dict[str, str]]:
    """The right choice, and the others."""
    low = lambda x: d.strip(f"lower({x})")
    return [{"correct": low(d.at("qv", -1)), "offered": d.map(d.part("qv", 1, 1), low), "parts": d.sentences("r")}, {"wrong": d.filter("offered", lambda x: f"{x} <> correct")}]


@shared("ecqa_negative")
def _(d: Dialect) -> list[dict[str, str]]:
    bare = lambda x: d.trim(x, ".,!?;:")
    first, second = choices_by_worth(d)
    first |= {"asked": d.map(asked_words(d), bare), "said": d.map(d.words("ru"), bare)}
    second |= {"overlap": f"{d.size(d.filter('said', lambda x: d.holds('asked', x)))} / {d.num(1.0)} / greatest(1, {d.size('said')})", "n_correct": d.count_word("ru", "correct")}
    return [first, second, {"share": f"{d.size(d.filter('wrong', lambda x: d.has_word('ru', x)))} / {d.num(1.0)} / greatest(1, {d.size('wrong')})"}]


@named("ecqa_negative", "incorrect_choices_coverage")
def _(d: Dialect) -> str:
    score = d.when("n_correct > 2", d.floor0(f"share - least((n_correct - 2) * {d.num(0.1)}, {d.num(0.3)})"), "share")
    return f"CASE WHEN {d.size('qv')} < 3 THEN {d.num(0.0)} WHEN {d.size('wrong')} = 0 THEN {d.num(0.0)} ELSE {score} END"


def mean_over_sentences(d: Dialect, score: Callable[[str], str]) -> str:
    n = d.size("parts")
    return d.when(f"{n} = 0", d.num(0.0), f"{d.total(d.map('parts', score))} / greatest(1, {n})")


@named("ecqa_negative", "atomic_sentence_format")
def _(d: Dialect) -> str:
    def score(x: str) -> str:
        joined = f"least({d.count_match(f'lower({x})', CONJUNCTIONS)} * {d.num(0.3)}, {d.num(0.6)})"
        return d.floor0(f"{d.ladder(d.size(d.words(x)), [(20, 1.0), (30, 0.7)], 0.4)} - {joined}")

    return mean_over_sentences(d, score)


@named("ecqa_negative", "external_knowledge_usage")
def _(d: Dialect) -> str:
    lost = d.when("overlap > 0.5", f"least(overlap - {d.num(0.5)}, {d.num(0.3)})", d.num(0.0))
    known = f"least({d.count_match('ru', KNOWLEDGE)} * {d.num(0.08)}, {d.num(0.3)})"
    return d.when(f"ru = '' OR {d.size('qv')} = 0", d.num(0.0), d.clamp(f"{d.num(1.0)} - {lost} + {known} + {d.weight(f'{d.count_match("ru", DEFINITIONS)} >= 2', 0.1)}"))


# ---- why the right choice is right -----------------------------------------------------------------

# Marks of complex sentences with what they cost, and comparisons.
COMPLEX = [(r"\bwhich\b", 0.3), (r"\bthat\b.*\b(is|are|was|were|provides|makes)\b", 0.25), (r"\bwhen\b", 0.2), (r"\bif\b", 0.2), (r",\s*and\b", 0.25), (r",\s*but\b", 0.25), (r",\s*which\b", 0.3), (r"\bmaking\b", 0.2), (r"\bfitting\b", 0.2), (r"\bimplying\b", 0.2)]
COMPARISONS = [r"\bother\s+(?:options|choices)\b", r"\bunlike\b", r"\bcompared\s+to\b", r"\brather\s+than\b", r"\binstead\s+of\b", r"\bwhile\s+(?:the\s+)?other\b"]


@shared("ecqa_positive")
def _(d: Dialect) -> list[dict[str, str]]:
    return choices_by_worth(d)


@named("ecqa_positive", "simple_atomic_sentences")
def _(d: Dialect) -> str:
    def score(x: str) -> str:
        kept = lambda low: f"{d.num(1.0)} - {' - '.join(d.weight(d.matches(low, p), v) for p, v in COMPLEX)}"
        return d.floor0(f"{d.let(f'lower({x})', kept)} - {d.ladder(d.size(d.words(x)), [(25, 0.3), (20, 0.2), (15, 0.1)], 0.0, '>')}")

    return mean_over_sentences(d, score)


@named("ecqa_positive", "correct_answer_focus")
def _(d: Dialect) -> str:
    named_wrong = d.size(d.filter("wrong", lambda x: d.has_word("ru", x)))
    score = d.floor0(f"{d.num(1.0)} - {named_wrong} * {d.num(0.25)} - {d.count_match('ru', COMPARISONS)} * {d.num(0.15)}")
    return f"CASE WHEN ru = '' OR {d.size('qv')} < 2 THEN {d.num(0.0)} WHEN {d.has_word('ru', 'correct')} THEN {score} ELSE {d.num(0.0)} END"


@named("ecqa_positive", "concise_justification")
def _(d: Dialect) -> str:
    n = d.size("parts")
    mean = f"({d.total(d.map('parts', lambda x: f'CAST({d.size(d.words(x))} AS DOUBLE)'))} / greatest(1, {n}))"
    number = d.ladder(n, [(1, 1.0), (2, 0.95), (3, 0.9), (4, 0.7), (6, 0.5)], 0.2)
    size = d.ladder(mean, [(15, 1.0), (20, 0.9), (25, 0.7), (30, 0.5)], 0.3)
    return d.when(f"{n} = 0", d.num(0.0), f"{number} * {d.num(0.6)} + {size} * {d.num(0.4)}")


# ---- explanation of edits ----------------------------------------------------------------------------

# Terms of correction, and words that don't count.
CORRECTION_TERMS = ["spelling", "grammar", "punctuation", "capitalization", "word choice", "corrected", "changed", "replaced", "added", "removed", "fixed", "error", "mistake", "wrong", "incorrect", "subject-verb", "agreement", "tense", "plural", "singular", "article"]
COMMON_WORDS = ["the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "in", "on", "at", "to", "for", "of", "with", "by"]


def bullets(d: Dialect, s: str) -> str:
    return d.size(d.filter(d.lines(s), lambda x: d.matches(x, r"^\s*[-•*]")))


@shared("gmeg")
def _(d: Dialect) -> list[dict[str, str]]:
    return [{"ours": bullets(d, "r0"), "theirs": bullets(d, "e0")}]


@named("gmeg", "bullet_point_ratio", True)
def _(d: Dialect) -> str:
    ours, theirs = "ours", "theirs"
    ratio = f"({ours} / {d.num(1.0)} / greatest(1, {theirs}))"
    off = f"abs({ratio} - {d.num(1.0)})"
    near = f"CASE WHEN {ratio} BETWEEN {d.num(0.8)} AND {d.num(1.2)} THEN {d.num(1.0)} - {off} * {d.num(2.0)} WHEN {ratio} BETWEEN {d.num(0.5)} AND {d.num(1.5)} THEN {d.num(0.8)} - {off} * {d.num(1.5)} ELSE {d.num(0.5)} - {off} * {d.num(0.5)} END"
    return f"CASE WHEN {theirs} = 0 THEN {d.weight(f'{ours} = 0', 1.0)} ELSE {d.clamp(near)} END"


@named("gmeg", "correction_terminology_recall", True)
def _(d: Dialect) -> str:
    ours, theirs = d.count_sub("ru", CORRECTION_TERMS), d.count_sub("lower(e0)", CORRECTION_TERMS)
    return f"CASE WHEN {theirs} > 0 THEN least({ours} / {d.num(1.0)} / greatest(1, {theirs}), {d.num(1.0)}) WHEN {ours} = 0 THEN {d.num(1.0)} ELSE {d.num(0.5)} END"


@named("gmeg", "structural_format_match", True)
def _(d: Dialect) -> str:
    return d.weight("(ours > 0) = (theirs > 0)", 1.0)


@named("gmeg", "original_text_mention")
def _(d: Dialect) -> str:
    counted = d.filter(d.words(d.at("qv", 0)), lambda x: f"length({x}) > 2 AND NOT {d.one_of(f'lower({x})', COMMON_WORDS)}")
    distinct = d.distinct(d.map(counted, lambda x: d.trim(f"lower({x})", '.,!?";')))
    share = f"{d.size(d.filter(distinct, lambda x: f'contains(ru, {x})'))} / {d.num(1.0)} / greatest(1, {d.size(distinct)})"
    return f"CASE WHEN {d.size('qv')} < 2 THEN {d.num(0.0)} WHEN {d.size(distinct)} = 0 THEN {d.num(1.0)} ELSE {share} END"


# ---- yes, no or maybe ----------------------------------------------------------------------------------

ANSWERS = ["yes", "no", "maybe"]


def verdict(d: Dialect) -> str:
    """A lone answer, else the first of yes, no and maybe that stands as a word; null if none does."""
    return "CASE " + " ".join(f"WHEN {d.matches('rl', rf'\b{a}\b')} THEN {d.lit(a)}" for a in ANSWERS) + " END"


shared("pubmedqa_free")(lambda d: [{"told": verdict(d)}])
shared("pubmedqa_required")(lambda d: [{"told": verdict(d)}])


def answered(d: Dialect) -> str:
    return d.weight("coalesce(told = el, FALSE)", 1.0)


named("pubmedqa_free", "answer_correctness", True)(answered)
named("pubmedqa_required", "answer_correctness", True)(answered)


@named("pubmedqa_free", "strict_format_compliance")
def _(d: Dialect) -> str:
    capital = [a.capitalize() for a in ANSWERS]
    bare = lambda s: d.trim(s, ".,!?;: ")
    steps = [(d.one_of("r", ANSWERS), 1.0), (d.one_of("r", capital), 0.8), (d.one_of(bare("r"), ANSWERS), 0.5), (d.one_of(bare("r"), capital), 0.4), (f"{d.size(d.words('r'))} = 1 AND {d.one_of(bare('rl'), ANSWERS)}", 0.3)]
    return "CASE " + " ".join(f"WHEN {c} THEN {d.num(v)}" for c, v in steps) + f" ELSE {d.num(0.0)} END"


@named("pubmedqa_free", "no_explanation_penalty")
def _(d: Dialect) -> str:
    lone = f"{d.size(d.words('r'))} = 1"
    return f"CASE WHEN r = '' THEN {d.num(0.0)} WHEN {lone} AND length(r) <= 10 THEN {d.num(1.0)} WHEN {lone} AND length(r) <= 15 THEN {d.num(0.7)} ELSE {d.ladder('length(r)', [(50, 0.4), (100, 0.2)], 0.0)} END"


@named("pubmedqa_required", "maybe_overuse_penalty", True)
def _(d: Dialect) -> str:
    return f"CASE WHEN coalesce(told, 'maybe') <> 'maybe' THEN {d.num(1.0)} WHEN el = 'maybe' THEN {d.num(1.0)} WHEN el IN ('yes', 'no') THEN {d.num(0.3)} ELSE {d.num(0.5)} END"


@named("pubmedqa_required", "confidence_calibration", True)
def _(d: Dialect) -> str:
    return f"CASE WHEN told IS NULL THEN {d.num(0.0)} WHEN told = 'maybe' THEN {d.weight("el = 'maybe'", 0.2)} + {d.num(0.5)} WHEN told = el THEN {d.num(1.0)} ELSE {d.num(0.5)} END"


#: Metrics of each module, in the order of their definition.
MODULES: dict[str, list[str]] = {}
for _module, _metric in RULES:
    MODULES.setdefault(_module, []).append(_metric)

# The module that scores each setup.
SETUP_MODULES = {
    "gmeg": "gmeg",
    "gmeg_ours": "gmeg",
    "RHAI_cose_explanation_with_answer": "cose_justification",
    "RHAI_cose_explanation_with_answer_and_questions": "cose_justification",
    "RHAI_cose_explanation": "cose_explanation",
    "RHAI_cose_choice_selection": "cose_choice",
    "ecqa_choice": "ecqa_choice",
    "ecqa_choice_selection_3choices": "ecqa_choice",
    "ecqa_choice_selection_no_concept": "ecqa_choice",
    "ecqa_positive": "ecqa_positive",
    "ecqa_negative": "ecqa_negative",
    "ecqa_freeflow": "ecqa_freeflow",
    "ecare_choice_selection": "ecare_choice",
    "ecare_explanation_generation": "ecare_explanation",
    "pubmedqa_reasoning_free": "pubmedqa_free",
    "pubmedqa_reasoning_required": "pubmedqa_required",
}
