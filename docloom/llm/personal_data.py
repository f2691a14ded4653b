"""Personal data by weak supervision. DataFrame and SQL functions only, over whole texts.

Four base kinds follow fixed patterns. Four further kinds (access secrets, telephone numbers without a country code,
bank accounts and national identity numbers) are proposed by broad patterns, voted on by pattern, gazetteer, context and
check-digit labelers whose reliabilities expectation-maximisation estimates, and decided by a span classifier that is
trained on the resulting posteriors and decides alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns. Each begins where its leftmost match must: at the start of a run of the characters it
# may begin with, or where the match before it ended. Repeated groups without a bound are possessive: the regular
# expression engine walks those in a loop, any other it walks by recursion, whose depth a long text exceeds.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(text, '@')"),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", r"text RLIKE '[0-9]\\.[0-9]'"),
    "card": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])", r"text RLIKE '[0-9]([\\x20-]?[0-9]){12}'"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "contains(text, '+')"),
}
PROPOSED = {
    "secret": (r"(?<![A-Za-z0-9])[A-Za-z0-9]{24,}+", r"text RLIKE '[A-Za-z0-9]{24}'"),
    "local_phone": (r"(?<![0-9+.()-])(?<![0-9+]\x20)\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"text RLIKE '[0-9]{3}[\\x20.-][0-9]{4}'"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"text RLIKE '[A-Z]{2}[0-9]{2}'"),
    "national_id": (r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", r"text RLIKE '[0-9]-[0-9]{2}-[0-9]{4}'"),
}
KINDS = (*BASE, *PROPOSED)
# Words that announce each proposed kind, and words that announce something else of the same shape.
GAZETTEER = {
    "secret": "token|secret|password|passwd|passphrase|pwd|api.?key|access.?key|private.?key|auth|bearer|credential|passwort|kennwort|mot de passe|contrase|clave",
    "local_phone": "phone|call|tel|fax|mobile|mobil|cell|dial|whatsapp|sms|contact|handy|anruf|appel|llam",
    "iban": "iban|account|bank|transfer|payee|konto|compte|cuenta|virement",
    "national_id": "ssn|social|security|tax.?id|national.?id|insurance|identity|dni|nif|steuer",
}
OTHER_THINGS = {
    "secret": "sha-?[0-9]*|md5|commit|checksum|digest|revision|hash|etag|sequence|genome",
    "local_phone": "isbn|order|invoice|version|serial|ratio|score|ticket|case|ref|page",
    "iban": "model|part|serial|sku|version|flight|chapter|code",
    "national_id": "part|serial|model|sku|order|invoice|version|case|ticket|date",
}
SUM_BASE = 64

VOTES = ("v_pattern", "v_words", "v_other", "v_context", "v_check")
FEATURES = (*VOTES, "f_size", "f_share", "f_before", "f_after")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def totals_before(values: Column, plus: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """For each element, what ``plus`` makes of 0 and all earlier elements; values are an array of int.

    An accumulated array would be copied at each step. Here blocks of 64 are summed, and blocks of those, and so on;
    then each element adds what stands before it in its block to what its block starts with. Linear in the array; the
    blocks of the last level, one for 4,096 elements, are added up plainly.
    """
    zero = F.lit(0)
    fold = lambda part: F.aggregate(part, zero, plus)

    def level(own: Column, depth: int) -> Column:
        within = lambda i: fold(F.slice(own, (F.floor(i / SUM_BASE) * SUM_BASE + 1).cast("int"), F.pmod(i, F.lit(SUM_BASE)).cast("int")))
        if not depth:
            return F.transform(own, lambda _, i: fold(F.slice(own, F.lit(1), i)))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / SUM_BASE).cast("int")), lambda b: fold(F.slice(own, b * SUM_BASE + 1, F.lit(SUM_BASE))))
        return let(blocks, lambda up: let(level(up, depth - 1), lambda start: F.transform(own, lambda _, i: plus(F.get(start, F.floor(i / SUM_BASE).cast("int")), within(i)))))

    return F.when(F.size(values) > 0, let(values, lambda own: level(own, levels))).otherwise(F.array().cast("array<int>"))


def _valid(kind: str) -> str:
    digits = "regexp_replace(x.value, '[^0-9]', '')"
    if kind == "ip":
        return "forall(split(x.value, '[.]'), p -> coalesce(try_cast(regexp_replace(p, '^0+', '0') AS decimal(38,0)), 999) <= 255)"
    if kind == "card":
        digit = f"cast(substring(reverse({digits}), i, 1) AS int)"
        return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END) % 10 = 0"
    if kind == "phone":
        return f"length({digits}) BETWEEN 9 AND 15"
    if kind == "secret":
        return "x.value RLIKE '[0-9]' AND x.value RLIKE '[A-Za-z]'"
    return "true"


def _placed(found: Column) -> Column:
    """(start, end, value, 24 characters before, one after) of values with the texts between them, in code points.

    A split by the pattern gives what lies between the matches, so starts are sums of lengths.
    """
    gap = lambda i: F.get(found["gaps"], i)
    spans = lambda width, at: F.transform(
        found["values"],
        lambda v, i: F.struct(
            (F.get(at, i) + F.length(gap(i))).alias("start"), (F.get(at, i) + F.get(width, i)).alias("end"), v.alias("value"),
            F.right(gap(i), F.lit(24)).alias("before"), F.left(gap(i + 1), F.lit(1)).alias("after"),
        ),
    )
    widths = F.transform(found["values"], lambda v, i: F.length(gap(i)) + F.length(v))
    return let(widths, lambda width: let(totals_before(width, lambda a, b: a + b), lambda at: spans(width, at)))


def _located(docs: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds, by kind, the valid leftmost matches of its pattern, as at_<kind>."""
    none = F.struct(*[F.array().cast("array<string>").alias(c) for c in ("values", "gaps")])
    found = lambda pattern: F.struct(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)).alias("values"), F.split("text", pattern, -1).alias("gaps"))
    # Every kind but email has a digit in what is valid, so one look at a text settles most texts for all kinds.
    every = F.array(*[F.when(F.expr(guard), found(pattern)).otherwise(none) for pattern, guard in patterns.values()])
    every = F.when(F.expr("text RLIKE '[0-9@]'"), every).otherwise(F.array(*[none] * len(patterns)))
    # One expression places the matches of all kinds: it is large, and a copy for each kind would slow the planning.
    placed = docs.withColumn("placed", F.transform(every, _placed))
    return placed.select(*docs.columns, *[F.expr(f"filter(get(placed, {k}), x -> {_valid(kind)})").alias(f"at_{kind}") for k, kind in enumerate(patterns)])


def _features(kind: str) -> dict[str, str]:
    """Labeler votes (1, -1, 0 abstains) and further classifier features of a proposed span x, as SQL."""
    announced = f"CASE WHEN lower(x.before) RLIKE '({GAZETTEER[kind]})' THEN 1 ELSE 0 END"
    other = f"CASE WHEN lower(x.before) RLIKE '(^|[^a-z])({OTHER_THINGS[kind]})[^a-z]*$' THEN -1 ELSE 0 END"
    context = r"CASE WHEN x.before RLIKE '[=:]\\s*[\"\']?$' THEN 1 WHEN x.before RLIKE '[$#/_%-]$' OR x.after RLIKE '[%/_]' THEN -1 ELSE 0 END"
    share = "length(regexp_replace(x.value, '[^0-9]', '')) / length(x.value)"
    own = {
        "secret": (
            "CASE WHEN x.value RLIKE '^(AKIA|ASIA|AIza|eyJ|ghp|gho|glpat|xox|sk|pk)' THEN 1 WHEN x.value RLIKE '^[A-Za-z]+[0-9]{1,4}$' THEN -1 ELSE 0 END",
            # Random text changes between letters and digits often; words and numbers do not.
            "CASE WHEN 5 * length(regexp_replace(x.value, '([0-9](?=[A-Za-z])|[A-Za-z](?=[0-9]))|.', '$1')) >= length(x.value) THEN 1"
            " WHEN 10 * length(regexp_replace(x.value, '([0-9](?=[A-Za-z])|[A-Za-z](?=[0-9]))|.', '$1')) < length(x.value) THEN -1 ELSE 0 END",
        ),
        "local_phone": (
            "CASE WHEN x.value RLIKE '^[(][0-9]{3}[)]' THEN 1 WHEN x.value RLIKE '^[0-9]+[.][0-9]+[.]' THEN -1 ELSE 0 END",
            # Area and exchange codes begin with 2 to 9, and both separators are alike.
            "CASE WHEN x.value RLIKE '^[(]?[01]' OR x.value RLIKE '^[(]?[0-9]{3}[)]?.[01]' THEN -1 WHEN x.value RLIKE '^([(][0-9]{3}[)].[0-9]{3}-|[0-9]{3}(.)[0-9]{3}\\\\2)' THEN 1 ELSE 0 END",
        ),
        "iban": (
            "CASE WHEN x.value RLIKE '^[A-Z]{2}[0-9]{2}( [A-Z0-9]{4}){2,}' THEN 1 ELSE 0 END",
            "CASE WHEN aggregate(transform(sequence(1, length(replace(x.value, ' ', ''))), i -> ascii(substring(concat(substring(replace(x.value, ' ', ''), 5), left(replace(x.value, ' ', ''), 4)), i, 1))), 0,"
            " (r, c) -> CASE WHEN c < 65 THEN (r * 10 + c - 48) % 97 ELSE (r * 100 + c - 55) % 97 END) = 1 THEN 1 ELSE -1 END",
        ),
        "national_id": (
            "CASE WHEN x.value RLIKE '^([0-9])\\\\1\\\\1-' THEN -1 ELSE 0 END",
            "CASE WHEN x.value RLIKE '^(000|666|9)' OR x.value RLIKE '-00-' OR x.value RLIKE '0000$' THEN -1 ELSE 1 END",
        ),
    }[kind]
    return {
        "v_pattern": own[0],
        "v_words": announced,
        "v_other": other,
        "v_context": context,
        "v_check": own[1],
        "f_size": "least(length(x.value) div 8, 8)",
        "f_share": f"cast(least(4, floor(5 * {share})) AS int)",
        "f_before": r"CASE WHEN x.before = '' THEN 0 WHEN x.before RLIKE '[\"\']$' THEN 1 WHEN x.before RLIKE '[=:]\\s*$' THEN 2 WHEN x.before RLIKE '[a-z,]\\s$' THEN 3 WHEN x.before RLIKE '\\s$' THEN 4 ELSE 5 END",
        "f_after": r"CASE WHEN x.after = '' THEN 0 WHEN x.after RLIKE '[\"\']' THEN 1 WHEN x.after RLIKE '[.,;]' THEN 2 WHEN x.after RLIKE '\\s' THEN 3 ELSE 4 END",
    }


def _described(kind: str) -> str:
    return f"transform(at_{kind}, x -> named_struct('kind', '{kind}', " + ", ".join(f"'{k}', cast({v} AS int)" for k, v in _features(kind).items()) + "))"


#: What a labeler is believed to do before any data: the chance of each vote on personal data, and on other things.
BELIEF = ({-1: 0.05, 0: 0.45, 1: 0.5}, {-1: 0.4, 0: 0.5, 1: 0.1})
#: How many observed spans that belief weighs.
BELIEF_WEIGHT = 8.0


def fit_labelers(counts: dict[tuple[int, ...], int], rounds: int = 200) -> dict[tuple[int, ...], float]:
    """Expectation-maximisation over vote patterns and their counts: the posterior that a span with this pattern is personal.

    A labeler's votes depend on the true class alone; its table starts from a belief that counts as a few observations,
    so few spans do not turn it round. Plain arithmetic over at most 3**5 patterns.
    """
    if not counts:
        return {}
    width = len(next(iter(counts)))
    table = [[dict(BELIEF[0]), dict(BELIEF[1])] for _ in range(width)]
    prior, whole, post = 0.5, sum(counts.values()), {}
    for _ in range(rounds):
        for votes in counts:
            good = math.log(prior) + sum(math.log(table[k][0][v]) for k, v in enumerate(votes))
            bad = math.log(1 - prior) + sum(math.log(table[k][1][v]) for k, v in enumerate(votes))
            post[votes] = 1 / (1 + math.exp(max(-500.0, min(500.0, bad - good))))
        prior = (sum(post[v] * n for v, n in counts.items()) + 2) / (whole + 4)
        for k in range(width):
            for c in (0, 1):
                seen = {v: BELIEF_WEIGHT * BELIEF[c][v] for v in (-1, 0, 1)}
                for p, n in counts.items():
                    seen[p[k]] += n * (post[p] if c == 0 else 1 - post[p])
                table[k][c] = {v: s / sum(seen.values()) for v, s in seen.items()}
    return post


def fit_classifier(rows: list[tuple[tuple[int, ...], int]], post: dict[tuple[int, ...], float]) -> tuple[float, dict[tuple[int, int], float]]:
    """Naive Bayes over all features of a span, trained on the posteriors of its votes: a bias and the log-odds of each (feature, value).

    ``rows`` are (features, count); the votes are the first of the features. The prior is in the bias, and nowhere else.
    """
    votes = len(VOTES)
    good = sum(n * post[f[:votes]] for f, n in rows)
    bad = sum(n * (1 - post[f[:votes]]) for f, n in rows)
    weights = {}
    for k in range(len(FEATURES)):
        values = sorted({f[k] for f, _ in rows})
        for value in values:
            g = 1 + sum(n * post[f[:votes]] for f, n in rows if f[k] == value)
            b = 1 + sum(n * (1 - post[f[:votes]]) for f, n in rows if f[k] == value)
            weights[k, value] = math.log(g / (good + len(values))) - math.log(b / (bad + len(values)))
    return math.log((good + 1) / (bad + 1)), weights


def _accepts(kind: str, bias: float, weights: dict[tuple[int, int], float]) -> str:
    """SQL for the classifier's verdict on a proposed span x of this kind."""
    parts = _features(kind)
    score = [repr(bias)]
    for k, name in enumerate(FEATURES):
        cases = " ".join(f"WHEN {value} THEN {w!r}D" for (f, value), w in sorted(weights.items()) if f == k)
        if cases:
            score.append(f"CASE cast({parts[name]} AS int) {cases} ELSE 0D END")
    return " + ".join(f"({s})" for s in score) + " > 0"


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Returns (id, text, columns asked for, base, spans) for every row; both are arrays of (kind, start, end, value).

    ``base`` has the valid base matches, leftmost and non-overlapping by kind; ``spans`` those and the accepted spans
    of the further kinds, by kind, then start. Offsets are code points, ends exclusive. Training sees every proposed
    span of the table: its counts by votes and features (a bounded number) are all that reaches the driver.

    Defined cases: a null text is empty; an empty table gives an empty result and trains on nothing; null ids and
    repeated rows each give a row; parts of an address may have leading zeros; a text of any length, with any number of
    matches or a match of any length, takes time in proportion to its length; no two spans of a kind start together, so
    nothing ties; a span at log-odds of exactly 0 is not taken; ``keep`` may not name the four columns that are made
    here; further columns are ignored.
    """
    if clash := {id_col, text_col, "base", "spans"} & set(keep):
        raise ValueError(f"columns that are made here cannot be kept: {sorted(clash)}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), text.alias("text"), *[F.col(c).alias(f"_keep_{c}") for c in keep])
    proposed = _located(given.select("text"), PROPOSED).select(F.explode(F.concat(*[F.expr(_described(k)) for k in PROPOSED])).alias("s")).select("s.*")
    seen = proposed.groupBy("kind", *FEATURES).count().collect()
    accepts = {}
    for kind in PROPOSED:
        rows = sorted((tuple(r[f] for f in FEATURES), r["count"]) for r in seen if r["kind"] == kind)
        counts: dict[tuple, int] = {}
        for f, n in rows:
            counts[f[: len(VOTES)]] = counts.get(f[: len(VOTES)], 0) + n
        accepts[kind] = _accepts(kind, *fit_classifier(rows, fit_labelers(counts)))
    found = _located(given, BASE | PROPOSED)
    shape = "x -> named_struct('kind', '{0}', 'start', x.start, 'end', x.end, 'value', x.value)"
    base = F.concat(*[F.expr(f"transform(at_{k}, {shape.format(k)})") for k in BASE])
    more = F.concat(*[F.expr(f"transform(filter(at_{k}, x -> {accepts[k]}), {shape.format(k)})") for k in PROPOSED])
    out = found.withColumn("base", base).withColumn("spans", F.concat("base", more))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *[F.col(f"_keep_{c}").alias(c) for c in keep], "base", "spans")


def redacted(text: Column | str, spans: Column | str, piece: int = 1024) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, under the first's kind.

    The text is cut into pieces once, since finding a place in a string means walking to it; what lies between two
    spans is put together from the pieces that it touches.
    """
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / piece).cast("int"), F.floor((b - 1) / piece).cast("int")
        met = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.when(b > a, F.substr(met, F.pmod(a, F.lit(piece)) + 1, b - a)).otherwise("")

    def joined(pieces: Column, marks: Column, reach: Column) -> Column:
        told = F.transform(
            marks,
            lambda m, i: F.when(m["start"] >= F.get(reach, i), F.concat(between(pieces, F.get(reach, i), m["start"]), F.lit("<"), F.upper(m["kind"]), F.lit(">"))).otherwise(""),
        )
        return F.concat(F.array_join(told, ""), let(F.array_max(F.transform(marks, lambda m: m["end"])), lambda end: between(pieces, end, F.length(text))))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{piece}}}"), F.lit(0))
    ends = lambda marks: F.transform(marks, lambda m: m["end"])
    out = let(cut, lambda pieces: let(ordered, lambda marks: let(totals_before(ends(marks), lambda a, b: F.greatest(a, b)), lambda reach: joined(pieces, marks, reach))))
    return F.when(F.size(spans) > 0, out).otherwise(text)
