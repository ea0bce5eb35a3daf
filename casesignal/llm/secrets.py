"""Secrets in texts: known shapes, and strings that pass for random.

Known shapes are assignments to a secret's name, access keys, and long hex.
The method adds ``random`` spans. A candidate is a run of 16 characters or more
of the base64 alphabets whose encoding can be inferred: digits and letters, of
one case also with + / _ - between, or letters of both cases. It must meet two
conditions.

The battery: under "the characters are drawn evenly and independently" it gets
a chi-squared statistic of its alphabet counts, a runs test about the middle of
the alphabet, and a serial correlation; the three p-values are combined by
Bonferroni, and Benjamini-Hochberg sets aside those that are *not* random.

The discovery: the null says "written like the corpus". A model of which
character follows which is counted from the corpus's own runs. With P the
model's probability of the string and Q that of even draws, Q / P has mean one
at most under the null, so P / Q bounds the p-value whatever the length.
Benjamini-Hochberg on it bounds the share of text among the reported spans.

Both work within each encoding and doubling of the length: a long string has
evidence enough, a short one must not borrow its threshold. Equal strings are
one hypothesis, and a run that meets a known shape is none.

All of it is DataFrame functions: expressions on the text's row, and one small
aggregate of p-values in steps of 1 / ``STEPS``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casesignal.session import stored

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
KINDS = ("assign", "access", "hex", "random")

_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()
#: Encodings in the order they are tried: pattern and alphabet.
ENCODINGS = (
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", _DIGITS + "abcdef"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", _DIGITS + "ABCDEF"),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z]+$", _DIGITS + _UPPER),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z]+$", _DIGITS + _LOWER),
    (r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[0-9A-Za-z+/_-]+$", _UPPER + _LOWER + _DIGITS + "+/-_"),
    # One case, with marks: UUIDs, keys behind a prefix, tokens in a path.
    (r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f+/_-]+$", _DIGITS + "abcdef+/-_"),
    (r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F+/_-]+$", _DIGITS + "ABCDEF+/-_"),
    (r"^(?=.*[0-9])(?=.*[A-Z])[0-9A-Z+/_-]+$", _DIGITS + _UPPER + "+/-_"),
    (r"^(?=.*[0-9])(?=.*[a-z])[0-9a-z+/_-]+$", _DIGITS + _LOWER + "+/-_"),
    # Both cases without a digit.
    (r"^(?=.*[A-Z])(?=.*[a-z])[A-Za-z+/_-]+$", _UPPER + _LOWER + "+/-_"),
)
STEPS = 10_000
#: Matches that one fold puts in a list.
BLOCK = 256
#: Runs of fewer characters are words; longer ones are candidates.
LONG = 16
RUN = r"[A-Za-z0-9+/_-]+"
#: Symbols of the text model: letters of either case, any digit, any mark.
SYMBOLS = _LOWER + "0-"
#: Letters of English text in per cent, a to z; then digits and marks.
_PER_CENT = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074, 4.0, 1.5)
#: What the model expects before it has seen anything, and how many characters that is worth.
PRIOR = tuple(x / sum(_PER_CENT) for x in _PER_CENT)
WORTH = 20
#: Steps of a discovery's -ln p, in tenths.
TENTHS = 5000

_SPAN = "array<struct<start:bigint,end:bigint,text:string>>"


def _matches(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Start, end and text of each match, by code points; ``group`` of ``least`` or more.

    The pieces between matches give the places. They are added up in blocks of
    ``BLOCK`` and then over the blocks: one fold over all of them would copy its
    list at every match.
    """
    p = F.lit(pattern)
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"), F.regexp_extract_all(text, p, F.lit(group)).alias("part")
    )

    def step(acc: Column, z: Column) -> Column:
        lo = acc["at"] + F.length(z["gap"])
        hi = lo + F.coalesce(F.length(z["hit"]), F.lit(0))
        span = F.struct(lo.alias("start"), hi.alias("end"), z["hit"].alias("text"))
        good = z["hit"].isNotNull() & (F.length(z["part"]) >= least)
        return F.struct(hi.alias("at"), F.when(good, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["found"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["text"].alias("text")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["found"], F.array(moved)).alias("found"))

    def nothing(kind: str) -> Column:
        return F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found"))

    def all_blocks(z: Column) -> Column:
        places = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int"))
        blocks = F.transform(places, lambda b: F.aggregate(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)), nothing(_SPAN), step))
        return F.aggregate(blocks, nothing(f"array<{_SPAN}>"), join, lambda acc: F.flatten(acc["found"]))

    # A list of one, so that the matches are found once and not for every block.
    found = F.element_at(F.transform(F.array(zipped), all_blocks), 1)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_SPAN))


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to 1e-7, by a rational fit of erfc."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = F.lit(1.0) / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    half = poly * F.exp(-x * x) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def _values(text: Column, encoding: Column) -> Column:
    """Each character's place in its encoding's alphabet."""
    alphabet = F.element_at(F.array(*[F.lit(a) for _, a in ENCODINGS]), encoding + 1)
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.position(c, alphabet) - 1)


def _encoding(text: Column) -> Column:
    found = F.when(text.rlike(ENCODINGS[0][0]), 0)
    for i, (pattern, _) in enumerate(ENCODINGS[1:], 1):
        found = found.when(text.rlike(pattern), i)
    return found


def _with(rows: Column, **fields) -> Column:
    """Each struct of ``rows`` with further fields, each computed once."""

    def all_at_once(s: Column) -> Column:
        out = s
        for name, of in fields.items():
            out = out.withField(name, of(s))
        return out

    return F.transform(rows, all_at_once)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _neighbours(values: Column, of) -> Column:
    n = F.size(values) - 1
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), of)


def _tested(rows: Column) -> Column:
    """``rows`` (text, enc) with ``p``: the combined p-value; small: not random."""
    sizes = F.array(*[F.lit(float(len(a))) for _, a in ENCODINGS])
    rows = _with(rows, v=lambda s: _values(s["text"], s["enc"]), k=lambda s: F.element_at(sizes, s["enc"] + 1), n=lambda s: F.length(s["text"]).cast("double"))
    rows = _with(
        rows,
        squares=lambda s: _sum(F.transform(F.array_distinct(s["v"]), lambda v: F.pow(F.size(F.filter(s["v"], lambda x: x == v)).cast("double"), F.lit(2.0)))),
        sides=lambda s: F.transform(s["v"], lambda v: (v >= s["k"] / 2).cast("int")),
        mean=lambda s: _sum(s["v"]) / s["n"],
    )
    rows = _with(
        rows,
        chi=lambda s: s["k"] / s["n"] * s["squares"] - s["n"],
        runs=lambda s: 1 + _sum(_neighbours(s["sides"], lambda a, b: (a != b).cast("int"))),
        high=lambda s: _sum(s["sides"]),
        off=lambda s: F.transform(s["v"], lambda v: v - s["mean"]),
    )
    rows = _with(
        rows,
        both=lambda s: 2 * s["high"] * (s["n"] - s["high"]),
        power=lambda s: _sum(F.transform(s["off"], lambda v: v * v)),
        serial=lambda s: _sum(_neighbours(s["off"], lambda a, b: a * b)),
        z1=lambda s: (s["chi"] - (s["k"] - 1)) / F.sqrt(2 * (s["k"] - 1) * (s["n"] - 1) / s["n"]),
    )
    rows = _with(rows, spread=lambda s: s["both"] * (s["both"] - s["n"]) / (s["n"] * s["n"] * (s["n"] - 1)))
    # All on one side, or all alike: as far from random as can be.
    rows = _with(
        rows,
        z2=lambda s: F.when(s["spread"] > 0, F.abs((s["runs"] - 1 - s["both"] / s["n"]) / F.sqrt(s["spread"]))),
        z3=lambda s: F.when(s["power"] > 0, F.abs((s["serial"] / s["power"] + 1 / s["n"]) * F.sqrt(s["n"]))),
    )
    worst = lambda s: F.least(_tail(s["z1"]), *[F.coalesce(F.least(F.lit(1.0), 2 * _tail(s[z])), F.lit(0.0)) for z in ("z2", "z3")])
    return _with(rows, p=lambda s: F.least(F.lit(1.0), 3 * worst(s)))


@dataclass(frozen=True)
class TextModel:
    """``logs``: ln of the probability of each symbol after each other (none first);
    ``hold``, ``turn``: ln of a letter's keeping or changing the case of the letter before."""

    logs: list[float]
    hold: float
    turn: float


def _symbols(text: Column) -> Column:
    """Numbers from 1 in SYMBOLS of the characters."""
    folded = F.translate(F.lower(text), "0123456789+/_-", "0000000000----")
    return F.transform(F.filter(F.split(folded, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(SYMBOLS)))


def _pairs(text: Column) -> Column:
    """Number of each character's pair with the one before, none for the first."""
    now = _symbols(text)
    before = F.concat(F.array(F.lit(0)), F.slice(now, 1, F.size(now) - 1))
    return F.zip_with(before, now, lambda a, b: a * len(SYMBOLS) + b - 1)


_LETTERS, _TURNS = r"(?<=[A-Za-z])(?=[A-Za-z])", r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"


def text_model(docs: DataFrame, text_col: str = "text") -> TextModel:
    """The model of the runs of all texts, each as often as it occurs.

    A run of ``LONG`` characters or more that occurs once is left out: it may be
    what is looked for. At most len(SYMBOLS) * (len(SYMBOLS) + 1) counts are fetched.
    """
    runs = docs.select(F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.groupBy("run").agg(F.count("*").alias("n")).where((F.length("run") < LONG) | (F.col("n") > 1))
    case = F.struct(F.lit(-1).alias("pair"), F.regexp_count("run", F.lit(_LETTERS)).cast("long").alias("n"))
    turns = F.struct(F.lit(-2).alias("pair"), F.regexp_count("run", F.lit(_TURNS)).cast("long").alias("n"))
    each = F.concat(F.transform(_pairs(F.col("run")), lambda x: F.struct(x.alias("pair"), F.lit(1).cast("long").alias("n"))), F.array(case, turns))
    rows = runs.select("n", F.explode(each).alias("e")).groupBy(F.col("e.pair").alias("pair")).agg(F.sum(F.col("n") * F.col("e.n")).alias("n"))
    n = {r["pair"]: r["n"] for r in rows.collect()}
    k = len(SYMBOLS)
    logs = []
    for a in range(k + 1):
        total = sum(n.get(a * k + b, 0) for b in range(k))
        logs += [math.log((n.get(a * k + b, 0) + WORTH * PRIOR[b]) / (total + WORTH)) for b in range(k)]
    turn = (n.get(-2, 0) + WORTH / 10) / (n.get(-1, 0) + WORTH)
    return TextModel(logs, math.log(1 - turn), math.log(turn))


def _evidence(s: Column, model: TextModel) -> Column:
    """ln Q / P: by how much even draws from the encoding explain the string better than the text model.

    The case of a letter that follows none is taken as given.
    """
    logs, text = F.array(*[F.lit(x) for x in model.logs]), s["text"]
    written = _sum(F.transform(_pairs(text), lambda x: F.get(logs, x)))
    digits, marks = (F.regexp_count(text, F.lit(p)) for p in ("[0-9]", "[+/_-]"))
    letters, turns = (F.regexp_count(text, F.lit(p)) for p in (_LETTERS, _TURNS))
    written = written - digits * math.log(10) - marks * math.log(4) + turns * model.turn + (letters - turns) * model.hold
    return -s["n"] * F.ln(s["k"]) - written


def _tests(found: Column, model: TextModel) -> Column:
    """start, end, group (encoding and doubling of the length), step of the
    battery's p-value, tenths of the discovery's -ln p, and the string's hash."""
    found = _with(found, enc=lambda s: _encoding(s["text"]))
    found = _tested(F.filter(found, lambda s: s["enc"].isNotNull()))

    def result(s: Column) -> Column:
        doubling = F.floor(F.log2(s["n"])).cast("int")
        tenths = F.greatest(F.lit(0), F.least(F.lit(TENTHS), F.floor(10 * _evidence(s, model)).cast("int")))
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), (doubling * len(ENCODINGS) + s["enc"]).alias("group"),
            F.ceil(s["p"] * STEPS).cast("int").alias("step"), tenths.alias("tenths"), F.xxhash64(s["text"]).alias("hash"),
        )

    return F.transform(found, result)


def not_random(tests: DataFrame, rate: float = 0.05) -> DataFrame:
    """``group`` and the last ``step`` at which Benjamini-Hochberg rejects "random".

    ``tests`` has a row (group, step) for each string. A p-value counts as
    its step's upper end.
    """
    bins = tests.groupBy("group", "step").agg(F.count("*").alias("n"))
    up = Window.partitionBy("group").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(up) / F.sum("n").over(Window.partitionBy("group"))
    bins = bins.withColumn("ok", F.col("step") / STEPS <= share * rate)
    return bins.where("ok").groupBy("group").agg(F.max("step").alias("last"))


def not_text(tests: DataFrame, rate: float = 0.05) -> DataFrame:
    """``group`` and the least ``tenths`` at which Benjamini-Hochberg rejects "written like the corpus"."""
    bins = tests.groupBy("group", "tenths").agg(F.count("*").alias("n"))
    down = Window.partitionBy("group").orderBy(F.desc("tenths")).rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum("n").over(down) / F.sum("n").over(Window.partitionBy("group"))
    bins = bins.withColumn("ok", F.exp(-F.col("tenths") / 10) <= share * rate)
    return bins.where("ok").groupBy("group").agg(F.min("tenths").alias("first"))


def _limits(rows: DataFrame, absent: int) -> Column:
    """The limit of each group, by its number. Groups: encodings times doublings of a length, below 400."""
    found = {r[0]: r[1] for r in rows.collect()}
    return F.array(*[F.lit(found.get(i, absent)) for i in range(max(found, default=0) + 1)])


def _last_before(spans: Column, end: Column) -> Column:
    """End of the last of ``spans`` that starts before ``end``; they are in order and apart. Found by halves."""
    halves = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))) + 1)
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = (acc["lo"] < acc["hi"]) & (F.get(spans, mid)["start"] < end)
        return F.struct(F.when(below, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(below, acc["hi"]).otherwise(mid).alias("hi"))

    return F.aggregate(halves, start, halve, lambda acc: F.get(spans, acc["lo"] - 1)["end"])


def find_secrets(docs: DataFrame, *, rate: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``base`` and ``spans``: arrays of (start, kind number, end).

    ``base`` holds the known shapes, ``spans`` also the random strings that
    overlap none of them; both by start, then kind as listed in KINDS. Places
    are code points, the end exclusive. A null text is empty. Repeated rows
    give repeated rows. ``rate`` bounds the share of text-like strings among the
    random ones, and of random strings among those that the battery sets aside.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    model = text_model(docs, text_col)

    def of(kind: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    def apart(t: Column) -> Column:
        met = [F.coalesce(_last_before(F.col(k), t["end"]) > t["start"], F.lit(False)) for k in KINDS[:3]]
        return ~(met[0] | met[1] | met[2])

    shapes = (_matches(text, ASSIGN, 2, 12), _matches(text, ACCESS), _matches(text, HEX))
    known = [of(i, m).alias(KINDS[i]) for i, m in enumerate(shapes)]
    # Stored, so that no lambda below finds the matches again.
    rows = stored(docs.select(F.col(id_col).alias("id"), *known, _matches(text, CANDIDATE).alias("found")), "secret-matches")
    base = F.array_sort(F.concat(*KINDS[:3])).alias("base")
    rows = stored(rows.select("id", base, _tests(F.filter("found", apart), model).alias("tests")), "secrets")
    tests = rows.select(F.explode("tests").alias("t")).groupBy("t.group", "t.hash")
    tests = stored(tests.agg(F.max("t.step").alias("step"), F.max("t.tenths").alias("tenths")), "secret-tests")
    last, first = _limits(not_random(tests, rate), -1), _limits(not_text(tests, rate), TENTHS + 1)

    def passes(t: Column) -> Column:
        drawn = t["step"] > F.coalesce(F.get(last, t["group"]), F.lit(-1))
        return drawn & (t["tenths"] >= F.coalesce(F.get(first, t["group"]), F.lit(TENTHS + 1)))

    random = of(3, F.filter("tests", passes))
    return rows.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", random)).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")
