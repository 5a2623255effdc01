"""Secret scans: fixed patterns, and a battery of randomness tests for the rest.

DataFrame functions only. Base spans come from three patterns. Besides, every run of 20 or
more characters of an encoding's alphabet that holds a letter is a candidate; ``=`` only ends
a run. A base span is cut out of a run, and each piece of 20 or more characters is a candidate,
as are its segments of that length between ``/``, between ``_`` or ``-``, and between any of
them: a random string glued to words is tested on its own too. A candidate's encoding (hexadecimal, base 32, alphanumeric, base 64) is inferred from its characters, and
as numbers of that alphabet it takes three tests of the hypothesis that it is random:
chi-squared uniformity of the alphabet, runs above and below the alphabet's middle, and
serial correlation. Fisher's sum combines them. Long strings give these tests more power
than short ones, so a Benjamini-Hochberg threshold is set in each class of length over the
whole corpus: candidates below it are dismissed as not random, with at most ``RATE`` of the
dismissals expected to be wrong, and the others are reported as spans of kind ``random``, without
those that lie inside another one.

Positions: a text is split by a pattern, and the lengths of the gaps and matches add up to
code point offsets. P-values of normal deviates use a logistic approximation of the normal
distribution; ranks of p-values are counted in bins, rounded to keep a candidate.

Nulls and edges: a null text counts as empty and has no spans; texts are scanned whole;
repeated rows each get a row; a null doc_id stays null; an empty table gives no rows; other
columns are ignored; spans with equal start come in the order assign, access, hex, random.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tripwright.llm.common import pick, text_or_empty
from tripwright.storage import materialize

ASSIGN = (r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|"""
          r"""[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
# Runs are maximal, so a pattern that asks for the least length finds the same ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+=*+"
SEPARATORS = ("/", "[_-]", "[/_-]")
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST, CANDIDATE_LEAST = 6, 20
LENGTH_EDGES = (32, 48, 64)
RATE = 0.05
BINS_PER_UNIT, BINS = 8, 1600

# fixed values: the alphabets in the order of their numbers
BASE16 = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def hits(kind: int, pattern: str, kept_group: int = 0) -> Column:
    """All matches of one kind in order, each with the gap before it."""
    text = F.col("text")
    found = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(kept_group)).alias("part"))
    gaps = F.split(text, pattern, -1)
    listed = F.transform(found, lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"),
        F.length(m["hit"]).alias("size"), F.length(m["part"]).alias("part_size"),
        (m["hit"] if kind == 3 else F.lit(None).cast("string")).alias("token")))
    return F.when(text.rlike(pattern), listed)


def found_spans(docs: DataFrame) -> DataFrame:
    """One row per match of any kind, and one with a null kind per document."""
    rows = pick(docs, "doc_id", "text").select(
        F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,part_size:int,token:string>>")
    marker = F.array(F.struct(F.lit(None).cast("int").alias("kind"), F.lit(0).alias("i"), F.lit(0).alias("gap"),
                              F.lit(0).alias("size"), F.lit(0).alias("part_size"),
                              F.lit(None).cast("string").alias("token")))
    lists = [marker, *[F.coalesce(h, none) for h in (hits(0, ASSIGN, 2), hits(1, ACCESS), hits(2, HEX), hits(3, CANDIDATE))]]
    each = rows.select("row", "doc_id", F.explode(F.concat(*lists)).alias("m")).select("row", "doc_id", "m.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.repartition("row").withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int"))
    placed = placed.withColumn("start", F.col("stop") - F.col("size"))
    return placed.filter(F.col("kind").isNull() | (F.col("kind") != 0) | (F.col("part_size") >= ASSIGN_LEAST))


def pieces(run: Column, base: Column) -> Column:
    """What the base spans leave of a run, where it is long enough: (start, token) each."""
    crossing = F.array_sort(F.filter(base, lambda b: (b["start"] < run["stop"]) & (run["start"] < b["stop"])))
    ends = F.concat(F.transform(crossing, lambda b: b["start"]), F.array(run["stop"]))
    left = F.transform(ends, lambda end, i: F.struct(
        F.array_max(F.concat(F.array(run["start"]), F.transform(F.slice(crossing, 1, i), lambda b: b["stop"]))).alias("start"),
        end.alias("stop")))
    long = F.filter(left, lambda x: x["stop"] - x["start"] >= CANDIDATE_LEAST)
    return F.transform(long, lambda x: F.struct(
        x["start"].alias("start"), F.substring(run["token"], x["start"] - run["start"] + 1, x["stop"] - x["start"]).alias("token")))


def segments(piece: Column, separator: str) -> Column:
    """The parts of a piece between separators that are long enough."""
    none = F.array().cast("array<struct<start:int,token:string>>")
    return F.aggregate(
        F.split(piece["token"], separator, -1), F.struct(piece["start"].alias("at"), none.alias("out")),
        lambda done, part: F.struct(
            (done["at"] + F.length(part) + 1).alias("at"),
            F.when(F.length(part) >= CANDIDATE_LEAST, F.concat(done["out"], F.array(F.struct(done["at"].alias("start"), part.alias("token")))))
            .otherwise(done["out"]).alias("out")))["out"]


def candidate_spans(found: DataFrame) -> DataFrame:
    """Base spans, the marker of each document, and all candidates with the run they are of."""
    is_base, is_run = F.col("kind") < 3, F.col("kind") == 3
    per_doc = found.groupBy("row", "doc_id").agg(
        F.collect_list(F.when(is_base, F.struct("start", "stop", "kind"))).alias("base"),
        F.collect_list(F.when(is_run, F.struct("start", "stop", "token"))).alias("runs"))

    def spans_of(run: Column) -> Column:
        left = pieces(run, F.col("base"))
        parts = F.flatten(F.transform(left, lambda x: F.concat(F.array(x), *[segments(x, by) for by in SEPARATORS])))
        return F.transform(F.array_distinct(parts), lambda x: F.struct(
            F.lit(3).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["token"])).alias("stop"),
            run["start"].alias("run"), x["token"].alias("token")))

    void = F.lit(None).cast("int")
    marker = F.array(F.struct(void.alias("kind"), void.alias("start"), void.alias("stop"), void.alias("run"), F.lit(None).cast("string").alias("token")))
    fixed = F.transform("base", lambda b: F.struct(
        b["kind"].alias("kind"), b["start"].alias("start"), b["stop"].alias("stop"), void.alias("run"), F.lit(None).cast("string").alias("token")))
    each = per_doc.select("row", "doc_id", F.explode(F.concat(marker, fixed, F.flatten(F.transform("runs", spans_of)))).alias("m"))
    return each.select("row", "doc_id", "m.*").filter("kind is null or kind <> 3 or token rlike '[A-Za-z]'").withColumn(
        "size", F.col("stop") - F.col("start"))


def two_sided(z: Column) -> Column:
    """P-value of a normal deviate by the logistic approximation; never quite 0."""
    size = F.least(F.abs(z), F.lit(12.0))
    return 2 / (1 + F.exp(1.5976 * size + 0.070566 * size * size * size))


def with_numbers(rows: DataFrame, token: str) -> DataFrame:
    """Add the candidate as numbers of its inferred alphabet, and the alphabet's size."""
    bare = F.regexp_replace(token, "=+$", "")
    encodings = [(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lower(bare), BASE16), (bare.rlike("^[A-Z2-7]+$"), bare, BASE32),
                 (bare.rlike("^[A-Za-z0-9]+$"), bare, ALNUM)]
    plain, alphabet = F.translate(bare, "-_=", "+/"), F.lit(BASE64)
    for fits, form, letters in reversed(encodings):
        plain, alphabet = F.when(fits, form).otherwise(plain), F.when(fits, F.lit(letters)).otherwise(alphabet)
    spelled = rows.withColumn("_plain", plain).withColumn("_alphabet", alphabet)
    numbers = F.transform(F.split("_plain", "(?!^|$)"), lambda c: (F.instr("_alphabet", c) - 1).cast("double"))
    return spelled.withColumn("numbers", numbers).withColumn("base", F.length("_alphabet").cast("double")).drop("_plain", "_alphabet")


def randomness(numbers: str, base: str) -> Column:
    """Combined p-value of the three tests over a column of numbers below ``base``."""
    k, n = F.col(base), F.size(numbers).cast("double")
    counted = F.transform(F.array_distinct(numbers), lambda v: F.pow(
        F.size(F.filter(numbers, lambda w: w == v)).cast("double"), F.lit(2.0)))
    uniform = (k / n * summed(counted) - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    before, after = F.slice(numbers, 1, F.size(numbers) - 1), F.slice(numbers, 2, F.size(numbers) - 1)
    turns = F.zip_with(before, after, lambda a, b: F.when((a < k / 2) != (b < k / 2), 1.0).otherwise(0.0))
    runs = (summed(turns) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    products = F.zip_with(before, after, lambda a, b: (a - (k - 1) / 2) * (b - (k - 1) / 2))
    serial = summed(products) / ((k * k - 1) / 12) / F.sqrt(n - 1)
    half = -(F.log(two_sided(uniform)) + F.log(two_sided(runs)) + F.log(two_sided(serial)))
    return F.exp(-half) * (1 + half + half * half / 2)  # chi-squared with 6 degrees of freedom


def summed(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, v: t + v)


def length_class(size: Column) -> Column:
    return sum(((size >= edge).cast("int") for edge in LENGTH_EDGES), F.lit(0))


def dismissal_bins(spans: DataFrame, rate: float = RATE) -> DataFrame:
    """Per class of length, the smallest bin of -log p from which candidates are dismissed."""
    counts = spans.filter("kind = 3").groupBy("length_class", "bin").agg(F.count(F.lit(1)).alias("n"))
    smaller = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    ranked = counts.select("length_class", "bin", F.sum("n").over(smaller).alias("rank"),
                           F.sum("n").over(Window.partitionBy("length_class")).alias("m"))
    reached = F.exp(-F.col("bin") / BINS_PER_UNIT) <= rate * F.col("rank") / F.col("m")
    return ranked.filter(reached).groupBy("length_class").agg(F.min("bin").alias("dismissed_from"))


def scan_secrets(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """Per document: doc_id and its spans (kind, start, stop) by start, stop exclusive."""
    p = F.when(F.col("kind") == 3, randomness("numbers", "base"))
    bin_ = F.least(F.lit(BINS), F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * BINS_PER_UNIT)).cast("int")
    spans = materialize(with_numbers(candidate_spans(found_spans(docs)), "token").select(
        "row", "doc_id", "kind", "start", "stop", "run", length_class(F.col("size")).alias("length_class"), bin_.alias("bin")), "spans")
    thresholds = dismissal_bins(spans, rate)  # one row per class of length
    judged = spans.join(F.broadcast(thresholds), "length_class", "left").filter(
        "kind is null or kind <> 3 or dismissed_from is null or bin < dismissed_from")
    before = Window.partitionBy("row", "kind", "run").orderBy("start", F.desc("stop")).rowsBetween(Window.unboundedPreceding, -1)
    outer = judged.repartition("row").withColumn("reached", F.max("stop").over(before)).filter(
        "kind is null or kind <> 3 or reached is null or reached < stop")
    one = F.struct("start", F.col("kind").alias("order"), "stop", F.get(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("kind"))
    per_doc = outer.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), one))).alias("all"))
    return per_doc.select("doc_id", F.transform("all", lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:stop of every span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def span_digests(scanned: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256 and the spans as text."""
    def of_kind(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != KINDS[3])
    return scanned.select("doc_id", *map(of_kind, KINDS[:3]), F.sha2(written(base), 256).alias("base_sha256"),
                          written(F.col("spans")).alias("spans"))
