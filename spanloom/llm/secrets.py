"""Secret scans, with DataFrame functions only.

Base spans come from fixed patterns, leftmost and non-overlapping per kind: assign (a keyword with a value of 12 or more
characters), access (AKIA keys of 18 or more) and hex (16 or more). The method adds entropy spans: candidates are runs of
`RUN` characters of 20 or more; a window of 20 characters slides over each. The counts of its characters are carried from
window to window, packed into seven integers; the one character that leaves and the one that enters change two counts, and with them
the sum of c log2 c, from which the window's Shannon entropy follows. A candidate's character class sets the threshold; the
span goes from the first window at or above it to the end of the last. Candidates that an allow-list pattern matches as a
whole, or with no window at the threshold, add no span.

Time and memory are in proportion to the text: long candidates are cut into overlapping runs of windows, and positions are
running sums by blocks. No pattern repeats a group that can backtrack, since java.util.regex walks those by recursion.

Positions are code points, ends exclusive. Spans are ordered by start, then by kind as listed: assign, access, hex,
entropy. Null text is empty text. Texts without spans have an empty list. Each row is judged alone, so equal rows are equal,
a repeated or null id means nothing, and an empty table gives an empty result. The results `base` and `all` take the place
of columns of those names; all other columns are carried along.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.shared import fresh

# Fixed patterns of the contract. {n,} keeps the same matches as + and a length test where a run can't begin inside itself.
ASSIGN = r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
RUN = r"[A-Za-z0-9+/=_-]{20,}"
#: Bits a character, of at most log2(16) and log2(20).
HEX_BITS, LETTER_BITS, OTHER_BITS = 3.0, 3.7, 3.7
#: The character classes of candidates and their thresholds; the first that fits counts.
CLASSES = ((r"[0-9a-fA-F]+", HEX_BITS), (r"[a-zA-Z]+", LETTER_BITS), (r"[A-Za-z0-9+/=_-]+", OTHER_BITS))
#: Candidates that are no secrets: identifiers in the form of UUIDs, words in one case, capitalised or
#: in camel case (other letters are judged by their entropy), digits only, dashed or slashed words.
ALLOWED = (r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}", r"[a-z]+", r"[A-Z]+", r"[a-z]*+(?:[A-Z][a-z]++)++", r"[0-9]+", r"[=_-]+", r"(?:[a-z]++|[A-Z][a-z]*+)(?:[-_/](?:[a-z]++|[A-Z][a-z]*+))++")

#: Windows of a candidate that one fold takes, and sums that one block of running sums holds.
STRETCH = 256
#: RUN's characters are numbered from the least; 12 counts of 5 bits are in an integer.
_LEAST, _COUNTS, _BITS = 43, 12, 5

_SPAN = "array<struct<start:int,kind:int,end:int>>"
_FOUND = "array<struct<start:int,end:int,v:string>>"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(steps: Column) -> Column:
    """Of each step the sum of those before it."""

    def sums(xs: Column, start: Column) -> Column:
        state = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, state, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def by_block(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda s, x: s + x))
        return F.flatten(F.zip_with(blocks, sums(totals, F.lit(0)), sums))

    blocks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(STRETCH)), lambda at: F.slice(steps, at, F.lit(STRETCH)))
    return F.when(F.size(steps) > 0, let(blocks, by_block)).otherwise(F.array().cast("array<int>"))


def located(text: Column, pattern: str, may: Column, value: Column | None = None) -> Column:
    """Array of (start, end, v) of all matches of pattern, v being value or the match. may: false where there is none for sure.

    Matches and the pieces between them alternate, so running sums of their lengths give the positions.
    """
    matches, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def place(x: Column) -> Column:
        gaps = F.transform(F.slice(x["p"], F.lit(1), F.size(x["m"])), lambda p: F.length(p))
        sizes = F.transform(x["m"], lambda m: F.length(m))
        before = running(F.zip_with(gaps, sizes, lambda g, n: g + n))
        zipped = F.arrays_zip(before.alias("b"), gaps.alias("g"), sizes.alias("n"), x["v"].alias("v"))
        return F.transform(zipped, lambda z: F.struct((z["b"] + z["g"]).alias("start"), (z["b"] + z["g"] + z["n"]).alias("end"), z["v"].alias("v")))

    found = let(F.struct(matches.alias("m"), pieces.alias("p"), (matches if value is None else value).alias("v")), place)
    return F.when(may, found.cast(_FOUND)).otherwise(F.array().cast(_FOUND))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def stretches(candidate: Column) -> Column:
    """candidate in pieces that overlap by a window less one character, so that each window is in one piece."""

    def overlapping(pieces: Column) -> Column:
        return F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.left(F.get(pieces, i + 1), F.lit(WINDOW - 1)), F.lit(""))))

    return let(F.regexp_extract_all(candidate, F.lit(f".{{1,{STRETCH}}}"), F.lit(0)), overlapping)


def hot_windows(piece: Column, threshold: Column) -> Column:
    """(first, last): the first and the last window (from 0) of piece with entropy at or above threshold; -1 if none."""
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])
    term = lambda c: F.element_at(terms, c.cast("int") + 1)
    # Entropy = log2(window) - sum / window, so it is at the threshold where the sum is at most this.
    most = (F.lit(math.log2(WINDOW)) - threshold) * WINDOW + 1e-9
    fields = -(-80 // _COUNTS)

    def mark(ch: Column) -> Column:
        code = F.ascii(ch) - _LEAST
        shift = F.pmod(code, F.lit(_COUNTS)) * _BITS
        return F.struct(F.floor(code / _COUNTS).cast("int").alias("at"), shift.alias("shift"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one"))

    def count(counts: Column, x: Column) -> Column:
        return F.call_function("shiftright", F.element_at(counts, x["at"] + 1), x["shift"]).bitwiseAND(F.lit((1 << _BITS) - 1))

    def change(counts: Column, x: Column, by: int) -> Column:
        return F.transform(counts, lambda c, k: F.when(k == x["at"], c + x["one"] * by).otherwise(c))

    def enter(acc: Column, x: Column) -> Column:
        """The counts and the sum with x."""
        return let(count(acc["counts"], x), lambda n: F.struct(change(acc["counts"], x, 1).alias("counts"), (acc["s"] - term(n) + term(n + 1)).alias("s")))

    def leave(acc: Column, x: Column) -> Column:
        return let(count(acc["counts"], x), lambda n: F.struct(change(acc["counts"], x, -1).alias("counts"), (acc["s"] - term(n) + term(n - 1)).alias("s")))

    def judged(window: Column, first: Column, last: Column, i: Column) -> Column:
        hot = window["s"] <= most
        return F.struct(window.alias("w"), F.when(hot & (first < 0), i).otherwise(first).alias("first"), F.when(hot, i).otherwise(last).alias("last"))

    def slide(chars: Column) -> Column:
        nothing = F.struct(F.array_repeat(F.lit(0).cast("long"), fields).alias("counts"), F.lit(0.0).alias("s"))
        opening = F.aggregate(F.slice(chars, F.lit(1), F.lit(WINDOW)), nothing, enter)
        none = F.lit(-1)
        opened = let(opening, lambda w: judged(w, none, none, F.lit(0)))
        more = F.size(chars) - WINDOW
        steps = F.when(more > 0, F.sequence(F.lit(1), more)).otherwise(F.array().cast("array<int>"))

        def step(acc: Column, i: Column) -> Column:
            less = leave(acc["w"], F.element_at(chars, i))
            window = let(less, lambda w: enter(w, F.element_at(chars, i + WINDOW)))
            return let(window, lambda w: judged(w, acc["first"], acc["last"], i))

        return F.aggregate(steps, opened, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return let(F.transform(F.filter(F.split(piece, ""), lambda ch: ch != ""), mark), slide)


def entropy_spans(text: Column) -> Column:
    """Spans of candidates with hot windows."""
    allowed = "^(?:" + "|".join(ALLOWED) + ")$"
    found = F.filter(located(text, RUN, text.rlike(RUN)), lambda x: ~x["v"].rlike(allowed))

    def judge(x: Column) -> Column:
        threshold = F.lit(CLASSES[-1][1])
        for pattern, bits in reversed(CLASSES[:-1]):
            threshold = F.when(x["v"].rlike(f"^{pattern}$"), F.lit(bits)).otherwise(threshold)

        def each(t: Column) -> Column:
            pieces = F.transform(stretches(x["v"]), lambda p, k: F.struct(F.when(F.length(p) >= WINDOW, hot_windows(p, t)).alias("w"), (k * STRETCH).alias("at")))
            hot = F.transform(F.filter(pieces, lambda p: p["w"]["first"] >= 0), lambda p: F.struct((p["at"] + p["w"]["first"]).alias("first"), (p["at"] + p["w"]["last"]).alias("last")))
            return let(hot, lambda h: F.struct(F.array_min(F.transform(h, lambda y: y["first"])).alias("first"), F.array_max(F.transform(h, lambda y: y["last"])).alias("last")))

        return F.struct(x["start"].alias("start"), let(threshold, each).alias("w"))

    hot = F.filter(F.transform(found, judge), lambda x: x["w"]["first"].isNotNull())
    return F.transform(hot, lambda x: F.struct((x["start"] + x["w"]["first"]).alias("start"), F.lit(3).alias("kind"), (x["start"] + x["w"]["last"] + WINDOW).alias("end")))


def scan(documents: DataFrame) -> DataFrame:
    """documents with base (array of start, kind, end of the fixed patterns) and all (with the entropy spans), both in order."""
    text = F.coalesce(F.col("text"), F.lit(""))
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))
    assign = F.filter(located(text, ASSIGN, text.rlike(ASSIGN), values), lambda x: F.length(x["v"]) >= 12)
    access = located(text, ACCESS, F.contains(text, F.lit("AKIA")) & text.rlike(ACCESS))
    hexes = located(text, HEX, text.rlike(HEX))
    base = F.concat(_spans(assign, "assign"), _spans(access, "access"), _spans(hexes, "hex")).cast(_SPAN)
    found, kept = fresh(documents, "found"), [c for c in documents.columns if c.lower() not in ("base", "all")]
    both = documents.withColumn(found, F.struct(F.array_sort(base).alias("base"), entropy_spans(text).cast(_SPAN).alias("more")))
    return both.select(*kept, F.col(f"{found}.base").alias("base"), F.array_sort(F.concat(f"{found}.base", f"{found}.more")).alias("all"))


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    """Base and entropy spans of every document."""
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("long")
    return found.select("doc_id", *[number(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(F.encode(joined(F.col("base")), "utf-8"), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))
