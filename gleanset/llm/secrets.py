"""Secret scan by a battery of randomness tests, in DataFrame functions only.

Base spans come from three patterns. The battery then looks at every other long token that
isn't a plain number or a word of some language: its encoding is inferred (the smallest alphabet that holds it), and
three statistics say how far it is from uniform random symbols of that alphabet: Pearson's
chi-squared of the symbol counts, the Wald-Wolfowitz runs about the alphabet's middle, and the
lag-1 serial correlation. Each is standardised, so S = max(0, z_chi)^2 + z_runs^2 + z_serial^2 is
about a chi-squared variable for random tokens and large for language.

Short tokens carry less evidence than long ones. False discoveries are therefore controlled by length: the
corpus's own purely alphabetical long words are the null distribution, if they are language: half of their runs of
``GRAM`` letters at least occur in ``GRAM_WORDS`` different words (so copies of a random token don't count), and in each bin of lengths
the cut on S is the largest for which the Benjamini-Hochberg estimate
m * P(null <= S) / #(candidates <= S) stays under ``fdr``. The null of a bin has the words of that
length or shorter, which are harder to tell apart. Only the two histograms (bins of length by bins
of S, a fixed number of rows) reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, load, text_of

# The base patterns, as the scan's contract states them.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: A token of the battery; shorter ones can't be told from language.
TOKEN_CHARS = "A-Za-z0-9+/_-"
TOKEN_LEAST = 20
WORD_LEAST = 16
LENGTH_STEP, LENGTH_BINS = 4, 32
SCORE_STEP, SCORE_BINS = 0.5, 60
#: Beyond this S (1 % of a chi-squared variable with 3 degrees) a token isn't random at all.
S_MOST = 11.3
FDR = 0.05
#: A word is language if so large a share of its runs of GRAM letters occur in GRAM_WORDS different words.
GRAM, GRAM_WORDS, GRAM_SHARE = 5, 3, 0.5

# Alphabets in the order of their encodings.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("^[0-9a-f]+$", DIGITS + "abcdef"),
    ("^[0-9A-F]+$", DIGITS + "ABCDEF"),
    ("^[a-z]+$", LOWER),
    ("^[A-Z2-7]+$", UPPER + "234567"),
    ("^[a-z0-9]+$", DIGITS + LOWER),
    ("^[A-Z0-9]+$", DIGITS + UPPER),
    ("^[A-Za-z0-9]+$", UPPER + LOWER + DIGITS),
)
BASE64 = UPPER + LOWER + DIGITS + "+/"


def located(text: Column, pattern: str, value_group: int = 0) -> Column:
    r"""Array of (from, to, value) of the leftmost non-overlapping matches, in code points from 0.

    ``\G(gap)(match)`` walks over the text once: the lengths of gap and match add up to places.
    """
    gapped = F.regexp_extract_all(text, F.lit(rf"\G(?s:.*?)(?:{pattern})"), F.lit(0))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if not value_group else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    sizes = F.transform(gapped, lambda g: F.char_length(g))
    ends = F.aggregate(sizes, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))
    return F.transform(F.arrays_zip(ends.alias("e"), whole.alias("m"), value.alias("v")), lambda z: F.struct((z["e"] - F.char_length(z["m"])).alias("from"), z["e"].alias("to"), z["v"].alias("value")))


NOTHING = "cast(array() AS array<struct<from:int,to:int,value:string>>)"


def _sum(a: Column, of) -> Column:
    return F.aggregate(F.transform(a, lambda v: of(v).cast("double")), F.lit(0.0), lambda s, v: s + v)


def battery(tokens: Column) -> Column:
    """S of each string of an array; tokens have 4 symbols or more, of the base64 or base64url alphabet."""

    def inferred(t: Column) -> Column:
        out = F.lit(BASE64)
        for pattern, alphabet in reversed(ENCODINGS):
            out = F.when(t.rlike(pattern), F.lit(alphabet)).otherwise(out)
        return out

    plain = F.transform(tokens, lambda t: F.translate(F.rtrim(t, F.lit("=")), "-_", "+/"))
    known = F.transform(plain, lambda t: F.struct(t.alias("t"), inferred(t).alias("a"), F.char_length(t).cast("double").alias("n")))
    coded = F.transform(
        known,
        lambda s: F.struct(
            s["n"].alias("n"),
            F.char_length(s["a"]).cast("double").alias("k"),
            F.transform(F.split(s["t"], ""), lambda c: F.instr(s["a"], c).cast("double")).alias("x"),
            F.aggregate(F.transform(F.array_distinct(F.split(s["t"], "")), lambda c: F.pow(s["n"] - F.char_length(F.replace(s["t"], c, F.lit(""))), F.lit(2.0))), F.lit(0.0), lambda acc, v: acc + v).alias("squares"),
        ),
    )

    def pairs(s: Column, of) -> Column:
        size = s["n"].cast("int") - 1
        return F.aggregate(F.zip_with(F.slice(s["x"], F.lit(1), size), F.slice(s["x"], F.lit(2), size), of), F.lit(0.0), lambda a, v: a + v)

    summed = F.transform(
        coded,
        lambda s: F.struct(
            s["n"].alias("n"),
            s["k"].alias("k"),
            s["squares"].alias("squares"),
            _sum(s["x"], lambda v: v).alias("sx"),
            _sum(s["x"], lambda v: v * v).alias("sxx"),
            pairs(s, lambda a, b: a * b).alias("sxy"),
            (F.element_at(s["x"], 1) + F.element_at(s["x"], -1)).alias("ends"),
            pairs(s, lambda a, b: F.when((a * 2 > s["k"]) != (b * 2 > s["k"]), 1.0).otherwise(0.0)).alias("changes"),
            _sum(s["x"], lambda v: F.when(v * 2 > s["k"], 1).otherwise(0)).alias("high"),
        ),
    )

    def score(s: Column) -> Column:
        n, k = s["n"], s["k"]
        chi = (s["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        both = 2 * s["high"] * (n - s["high"])
        runs_var = both * (both - n) / (n * n * (n - 1))
        runs = F.when(runs_var > 0, (s["changes"] - both / n) / F.sqrt(F.greatest(runs_var, F.lit(1e-9)))).otherwise(F.lit(9.0))
        mean = s["sx"] / n
        var = s["sxx"] - n * mean * mean
        cov = s["sxy"] - mean * (2 * s["sx"] - s["ends"]) + (n - 1) * mean * mean
        serial = F.when(var > 0, (cov / F.greatest(var, F.lit(1e-9)) + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
        return F.pow(F.greatest(chi, F.lit(0.0)), F.lit(2.0)) + runs * runs + serial * serial

    return F.transform(summed, score)


def _bin(length: Column) -> Column:
    return F.least(F.floor(length / LENGTH_STEP), F.lit(LENGTH_BINS - 1)).cast("int")


def _score_bin(s: Column) -> Column:
    return F.least(F.floor(s / SCORE_STEP), F.lit(SCORE_BINS - 1)).cast("int")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, tokens, null): base spans (from, kind, to), tokens of the battery with length bin and S,
    and the purely alphabetical words with their codes (length bin * SCORE_BINS + bin of S)."""
    df = text_of(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    t, empty = F.col("t"), F.expr(NOTHING)
    assign = rf"(?i){ASSIGN}"
    # No more than the least length is asked for where a shorter match can't hide a longer one.
    access, hexa = f"AKIA[A-Z0-9]{{{LEAST['access'] - 4},}}", f"[0-9a-f]{{{LEAST['hex']},}}"
    token = rf"(?<![{TOKEN_CHARS}])(?=[0-9]*[A-Za-z+/_-])[{TOKEN_CHARS}]{{{TOKEN_LEAST},}}={{0,2}}"
    word = rf"(?<![{TOKEN_CHARS}])[A-Za-z]{{{WORD_LEAST},}}(?![{TOKEN_CHARS}])"
    found = df.select(
        "doc_id",
        F.when(t.rlike(r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"), located(t, assign, 2)).otherwise(empty).alias("assign"),
        F.when(t.contains("AKIA") & t.rlike(access), located(t, access)).otherwise(empty).alias("access"),
        F.when(t.rlike(hexa), located(t, hexa)).otherwise(empty).alias("hex"),
        F.when(t.rlike(token), located(t, token)).otherwise(empty).alias("token"),
        F.transform(F.regexp_extract_all(t, F.lit(word), F.lit(0)), F.lower).alias("word"),
    )
    spans = lambda kind: F.transform(F.filter(kind, lambda s: F.char_length(s["value"]) >= LEAST[kind]), lambda s: F.struct(s["from"].alias("from"), F.lit(KINDS.index(kind)).alias("kind"), s["to"].alias("to")))
    based = found.select("doc_id", F.array_sort(F.concat(*map(spans, KINDS[:3]))).alias("base"), "token", "word")
    apart = lambda s: ~F.exists("base", lambda b: (b["from"] < s["to"]) & (s["from"] < b["to"]))
    apart_only = based.select("doc_id", "base", F.filter("token", apart).alias("token"), "word")
    scored = F.zip_with("token", battery(F.transform("token", lambda s: s["value"])), lambda s, z: F.struct(s["from"].alias("from"), s["to"].alias("to"), _bin(s["to"] - s["from"]).alias("bin"), z.alias("s"), F.when(s["value"].rlike("^[A-Za-z]+$"), F.lower(s["value"])).alias("word")))
    null = F.zip_with(F.transform("word", lambda w: _bin(F.char_length(w))), battery(F.col("word")), lambda b, z: b * SCORE_BINS + _score_bin(z))
    null = F.zip_with("word", null, lambda w, c: F.struct(w.alias("word"), c.alias("code")))
    return apart_only.select("doc_id", "base", scored.alias("tokens"), null.alias("null"))


def language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word): the long alphabetical words whose runs of letters other words have too."""
    t = F.lower("text")
    pattern = rf"(?<![{TOKEN_CHARS}])[a-z]{{{GRAM},}}(?![{TOKEN_CHARS}])"
    words = text_of(docs, id_col, text_col).select(F.explode(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))).alias("word")).distinct()
    runs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("word") - (GRAM - 1)), lambda i: F.substring(F.col("word"), i, F.lit(GRAM))))
    grams = words.select("word", F.explode(runs).alias("gram"))
    known = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= GRAM_WORDS).select("gram", F.lit(1.0).alias("known"))
    share = grams.where(F.char_length("word") >= WORD_LEAST).join(known, "gram", "left").groupBy("word").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("share"))
    return share.where(F.col("share") >= GRAM_SHARE).select("word")


def cuts(found: DataFrame, known: DataFrame, fdr: float = FDR) -> dict[int, float]:
    """By bin of lengths: the largest S at which the estimated share of false discoveries is ``fdr`` at most."""
    tokens = found.select(F.explode("tokens").alias("x")).select((F.col("x.bin") * SCORE_BINS + _score_bin(F.col("x.s"))).alias("code"), F.lit(0).alias("null"))
    words = found.select(F.explode("null").alias("x")).select("x.word", "x.code").groupBy("word", "code").agg(F.count(F.lit(1)).alias("n")).join(known, "word")
    counts = tokens.withColumn("n", F.lit(1)).unionByName(words.select("code", F.lit(1).alias("null"), "n")).groupBy("code", "null").agg(F.sum("n").alias("count"))
    table = {(r["null"], *divmod(r["code"], SCORE_BINS)): r["count"] for r in counts.collect()}  # 2 * LENGTH_BINS * SCORE_BINS rows at most
    out = {}
    for b in range(LENGTH_BINS):
        m = sum(table.get((0, b, s), 0) for s in range(SCORE_BINS))
        null = [sum(table.get((1, x, s), 0) for x in range(b + 1)) for s in range(SCORE_BINS)]
        total, seen, false = sum(null), 0, 0
        for s in range(int(S_MOST / SCORE_STEP)):
            seen += table.get((0, b, s), 0)
            false += null[s]
            if seen and m * (false + 1) / (total + 1) / seen <= fdr:
                out[b] = (s + 1) * SCORE_STEP
    return out


def secret_scan(docs: DataFrame, fdr: float = FDR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, found
    (array of (kind, from, to) in code points).

    Defined cases: null and empty texts have no spans; repeated rows are scanned each; a match of a base
    kind that is too short is dropped and not tried again; tokens of the battery that touch a base span
    are left out; a corpus without alphabetical words has no null distribution and adds none.
    """
    spark = docs.sparkSession
    work = Scratch(spark, "secrets")
    kept = work.keep(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "found")
    # Without any token that could pass there is nothing to decide.
    some = not kept.where(F.exists("tokens", lambda x: x["s"] < S_MOST)).isEmpty()
    cut = {}
    if some:
        known = work.keep(language(docs, id_col, text_col), "language")
        plain = kept.select("row", F.explode("tokens.word").alias("word")).join(known, "word").groupBy("row").agg(F.collect_set("word").alias("plain"))
        apart = F.filter("tokens", lambda x: x["word"].isNull() | ~F.array_contains(F.coalesce("plain", F.expr("cast(array() AS array<string>)")), x["word"]))
        kept = work.keep(kept.join(plain, "row", "left").withColumn("tokens", apart).drop("plain"), "apart")
        cut = cuts(kept, known, fdr)
    if cut:
        pairs = F.create_map(*[F.lit(v) for kv in cut.items() for v in kv])
        good = F.filter("tokens", lambda x: x["s"] < F.coalesce(F.try_element_at(pairs, x["bin"]), F.lit(-1.0)))
    else:
        good = F.filter("tokens", lambda x: F.lit(False))
    random = F.transform(good, lambda x: F.struct(x["from"].alias("from"), F.lit(3).alias("kind"), x["to"].alias("to")))
    named = lambda a: F.transform(a, lambda s: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["from"].alias("from"), s["to"].alias("to")))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["from"].cast("string"), s["to"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("all", lambda s: s["kind"] == k)).cast("long")
    return (
        kept.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("all"))
        .select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], named("base").alias("base"), named("all").alias("found"))
        .select("doc_id", "n_assign", "n_access", "n_hex", "n_random", F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"), "found")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(load(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
