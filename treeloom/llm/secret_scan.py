"""Secrets in texts: fixed patterns, and high-entropy windows of candidate strings. Native expressions only.

Patterns give the base spans. Candidates for the entropy scan are runs of token characters in what the base spans leave of
the text. A window of WINDOW characters slides over a candidate: a fold over its characters keeps the count of each one
inside the window (COUNTS to a long, BITS bits each) and, from the two counts that change, the sum of c * log2(c), which
gives each window's Shannon entropy. A candidate is a secret if its highest window reaches the limit of its character
class (hex, or mixed letters and digits), unless the allow-list knows it: UUIDs, addresses of pages, dates, and strings
that are plain words joined by punctuation. Placeholder words between delimiters are taken out before a candidate is scored.

Spans are found without Python: the pieces between matches (split) and the matches themselves give every offset, in code
points, by a running sum. All work is linear in the text but for that sum, n * sqrt(n) in the number of matches.

Defined cases: a null text counts as empty and has no spans; repeated rows are scanned one by one; an empty table gives an
empty result; other columns, of whatever names, are left alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treeloom.llm.common import let, running, text_or_empty

# The patterns of the three base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Bits per character that the highest window must reach, of at most log2(16) = 4 and log2(20) = 4.32.
HEX_BITS, TOKEN_BITS = 3.0, 3.6
PLACEHOLDER = r"(?i)(?<![A-Za-z0-9])(example|placeholder|changeme|lorem|dummy|sample|x{4,}|0{4,}|1234(567890?)?|abcd(ef)?)(?![A-Za-z0-9])"
ALLOWED = (
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    r"|^//|^[/_=+-]*[a-z]+([/_=+-]+[a-z]+)*[/_=+-]*$|^[0-9/_=+-]+$|^[A-Z]?[a-z]+[0-9]{0,4}$"
)
#: Tokens without a digit count as mixed from so many changes from small to capital letters on.
TURNS = 4
#: Counts of characters in the window: BITS bits each, COUNTS to a long, LONGS for the codes from '+' to 'z'.
BITS, COUNTS, LONGS = 5, 12, 7
#: Code points to a chunk, for pieces of a text: no piece is cut by counting from the start of the text.
CHUNK = 4096


def _spans(text: Column, pattern: str, rank: int, least: Column | None = None) -> Column:
    """Spans of the matches of a pattern: struct(start, rank, end, found). least: lengths of what must be long enough."""
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,found:string>>")

    def located(matches: Column) -> Column:
        def placed(gaps: Column) -> Column:
            steps = F.transform(matches, lambda m, i: (F.char_length(F.get(gaps, i)) + F.char_length(m)).cast("bigint"))
            span = lambda ends: F.transform(matches, lambda m, i: F.struct((F.get(ends, i) - F.char_length(m)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("end"), m.alias("found")))
            return let(running(steps, lambda a, b: a + b), span)

        return let(F.split(text, pattern, -1), placed)

    def chosen(matches: Column) -> Column:
        every = located(matches)
        return every if least is None else let(least, lambda n: F.filter(every, lambda s, i: F.get(n, i) >= 8))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, chosen(m)).otherwise(none))


def _replaced(text: Column, spans: Column, mark) -> Column:
    """text with mark(length) for every span, in order of their starts; a span that overlaps earlier ones only adds its rest."""

    def put(chunks: Column, upto: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            low = F.floor(start / CHUNK)
            held = F.array_join(F.slice(chunks, (low + 1).cast("int"), (F.floor((end - 1) / CHUNK) - low + 1).cast("int")), "")
            return F.when(start < end, F.substr(held, (start - low * CHUNK + 1).cast("int"), (end - start).cast("int"))).otherwise(F.lit(""))

        def part(s: Column, i: Column) -> Column:
            done = F.coalesce(F.get(upto, i - 1), F.lit(0).cast("bigint"))
            return F.concat(piece(done, s["start"]), mark(s["start"] >= done, F.greatest(s["end"] - F.greatest(done, s["start"]), F.lit(0).cast("bigint"))))

        last = F.get(upto, F.size(upto) - 1)
        return F.concat(F.array_join(F.transform(spans, part), ""), piece(last, F.char_length(text).cast("bigint")))

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    furthest = running(F.transform(spans, lambda s: s["end"]), F.greatest)
    return F.when(F.size(spans) == 0, text).otherwise(let(chunks, lambda c: let(furthest, lambda u: put(c, u))))


def highest_entropy(token: Column, window: int = WINDOW) -> Column:
    """Of all windows of a token of characters from '+' to 'z', the highest Shannon entropy in bits per character."""
    c_log_c = [c * math.log2(c) if c else 0.0 for c in range(window + 2)]
    gain = F.array(*[F.lit(c_log_c[c + 1] - c_log_c[c]) for c in range(window + 1)])
    shift = lambda way, value, by: F.call_function(way, value, by)

    def scan(places: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            into, out = F.get(places, i), F.get(places, i - window)
            held = lambda p: shift("shiftrightunsigned", F.get(acc["counts"], p["long"]), p["shift"]).bitwiseAND(F.lit((1 << BITS) - 1).cast("bigint")).cast("int")
            one = lambda p, k: F.when(p["long"] == k, shift("shiftleft", F.lit(1).cast("bigint"), p["shift"])).otherwise(F.lit(0).cast("bigint"))
            same = F.coalesce(((into["long"] == out["long"]) & (into["shift"] == out["shift"])).cast("int"), F.lit(0))
            now = acc["now"] - F.coalesce(F.get(gain, held(out) - 1), F.lit(0.0)) + F.get(gain, held(into) - same)
            counts = F.transform(acc["counts"], lambda c, k: c + one(into, k) - one(out, k))
            full = F.when(i >= window - 1, F.least(acc["least"], now)).otherwise(acc["least"])
            return F.struct(counts.alias("counts"), now.alias("now"), full.alias("least"))

        start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), LONGS).alias("counts"), F.lit(0.0).alias("now"), F.lit(float("inf")).alias("least"))
        return F.aggregate(F.sequence(F.lit(0), F.size(places) - 1), start, step)["least"]

    place = lambda c: let(F.ascii(c) - F.lit(ord("+")), lambda k: F.struct(F.floor(k / COUNTS).cast("int").alias("long"), (k % COUNTS * BITS).alias("shift")))
    letters = F.filter(F.split(token, ""), lambda x: x != "")
    return F.lit(math.log2(window)) - let(F.transform(letters, place), scan) / window


def _secret(token: Column) -> Column:
    def scored(rest: Column) -> Column:
        bits = F.when(rest.rlike("^[0-9A-Fa-f]+$"), F.lit(HEX_BITS)).otherwise(F.lit(TOKEN_BITS))
        mixed = (rest.rlike("[0-9]") & rest.rlike("[A-Za-z]")) | (F.regexp_count(rest, F.lit("[a-z][A-Z]")) >= TURNS)
        return F.when((F.char_length(rest) >= WINDOW) & mixed & ~rest.rlike(ALLOWED), highest_entropy(rest) >= bits).otherwise(F.lit(False))

    return let(F.regexp_replace(token, PLACEHOLDER, ""), scored)


def find(docs: DataFrame, text_col: str = "text", into: str = "secret_spans") -> DataFrame:
    """docs with a column of spans: array of struct(start, rank, end, found), by start and then kind."""
    text = text_or_empty(text_col)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), F.char_length)
    base = F.array_sort(F.concat(_spans(text, ASSIGN, 0, lengths), _spans(text, ACCESS, 1), _spans(text, HEX, 2)))
    more = lambda rest: F.filter(_spans(rest, CANDIDATE, 3), lambda s: _secret(s["found"]))
    blank = lambda first, n: F.repeat(F.lit(" "), n.cast("int"))
    return docs.withColumn(into, let(base, lambda b: F.array_sort(F.concat(b, let(_replaced(text, b, blank), more)))))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = find(docs.select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("secret_spans", lambda s: s["rank"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    n = [of_kind(k) for k in range(4)]
    base = _joined(F.filter("secret_spans", lambda s: s["rank"] < 3))
    return found.select("doc_id", *n[:3], F.sha2(base.cast("binary"), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"), n[3])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans by one); null texts stay null."""
    own = "_secret_spans_of_text"
    masked = _replaced(F.col("text"), F.col(own), lambda first, n: F.when(first, F.lit(mark)).otherwise(F.lit("")))
    return find(docs, into=own).withColumn("text", masked).drop(own)
