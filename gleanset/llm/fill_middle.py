r"""Fill-in-middle transformation by escaped marker injection, in Column expressions.

A delimiter is escaped in the text and then put after every unit (a code point, word or line) by one ``regexp_replace``. Counting
delimiters counts units, ``substring_index`` takes the units before and after a rank, and taking the delimiters out and
unescaping gives the parts back. Everything is a projection of one row: nothing is shuffled, and a text that is lost with its
executor is read again.

Cuts and forms follow from SHA-256 of ``1:`` and the document's id, so they are the same on every engine and partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import load

#: The delimiter, the character that escapes both, and what stands for each after an escape.
DELIMITER, ESCAPE = "\u0002", "\u0001"
ESCAPED = {ESCAPE: f"{ESCAPE}1", DELIMITER: f"{ESCAPE}2"}
#: What a unit is, over escaped text: an escaped character is never parted.
UNITS = {
    "char": rf"(?s){ESCAPE}[12]|.",
    "word": r"\s*\S+(?:\s+\z)?",
    "line": r"[^\n]*\n|[^\n]+",
}
# Markers of prefix, suffix and middle, and shares of the forms in percent.
MARKERS = ("<P>", "<S>", "<M>")
FIM_PERCENT, SPM_PERCENT = 90, 20


def escaped(text: Column) -> Column:
    """Text without any delimiter in it."""
    for char, out in ESCAPED.items():
        text = F.replace(text, F.lit(char), F.lit(out))
    return text


def unescaped(part: Column) -> Column:
    """The text of a marked part: injected delimiters go, escaped characters come back."""
    part = F.replace(part, F.lit(DELIMITER), F.lit(""))
    for char, out in reversed(ESCAPED.items()):
        part = F.replace(part, F.lit(out), F.lit(char))
    return part


def marked(text: Column, unit: str = "char") -> Column:
    """Escaped text with the delimiter after every unit."""
    return F.regexp_replace(escaped(text), UNITS[unit], f"$0{DELIMITER}")


def units(m: Column) -> Column:
    """How many units a marked text has."""
    return (F.length(m) - F.length(F.replace(m, F.lit(DELIMITER), F.lit("")))).cast("long")


def before(m: Column, rank: Column) -> Column:
    """The marked units up to the rank (0: none)."""
    return F.call_function("substring_index", m, F.lit(DELIMITER), rank.cast("int"))


def after(m: Column, n: Column, rank: Column) -> Column:
    """The marked units after the rank, and what follows the last unit."""
    return F.call_function("substring_index", m, F.lit(DELIMITER), (rank - n - 1).cast("int"))


def between(m: Column, low: Column, high: Column) -> Column:
    return F.call_function("substring_index", before(m, high), F.lit(DELIMITER), (low - high).cast("int"))


def hashes(doc_id: Column, salt: str = "1") -> list[Column]:
    """The first four 32-bit groups of SHA-256 of ``salt:id``."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def fill_middle(
    docs: DataFrame, unit: str = "char", fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
    markers: tuple[str, str, str] = MARKERS, salt: str = "1", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    With h1 to h4 of ``hashes``, the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) units and the middle after the
    larger. A text is plain if it is empty, holds a marker, or h3 % 100 reaches ``fim_percent``; of the others
    those with h4 % 100 below ``spm_percent`` are spm.

    Defined cases: null text is the empty text (plain, output empty); very long texts are cut whole; texts that hold the delimiter or
    the escape keep them; a null doc_id hashes as the empty id, and rows that repeat an id are cut alike; other columns
    aren't looked at, whatever their names; an empty table gives no rows.
    """
    p, s, m = (F.lit(x) for x in markers)
    h = hashes(F.col("doc_id"), salt)
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = out.select("doc_id", "text", marked(F.col("text"), unit).alias("marked"), *[x.alias(f"h{k}") for k, x in enumerate(h, 1)])
    out = out.select("*", units(F.col("marked")).alias("n"))
    cuts = [F.col(x) % (F.col("n") + 1) for x in ("h1", "h2")]
    plain = (F.col("text") == "") | (F.col("h3") % 100 >= fim_percent)
    for x in (p, s, m):
        plain = plain | F.contains("text", x)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    out = out.select("*", form.alias("form"), F.least(*cuts).alias("low"), F.greatest(*cuts).alias("high"))
    n, low, high, whole = F.col("n"), F.col("low"), F.col("high"), F.col("marked")
    parts = {"prefix": before(whole, low), "middle": between(whole, low, high), "suffix": after(whole, n, high)}
    out = out.select("doc_id", "text", "n", "form", *[F.when(F.col("form") != "plain", unescaped(x)).alias(k) for k, x in parts.items()])
    psm, spm = F.concat(p, "prefix", s, "suffix", m, "middle"), F.concat(s, "suffix", p, "prefix", m, "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return out.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output of that form was made of. Only texts without markers are transformed, so each marker occurs once."""
    p, s, m = markers
    body = F.substring(output, 1 + max(map(len, markers)), 2**31 - 1) if len({*map(len, markers)}) == 1 else F.regexp_replace(output, rf"^(?:\Q{p}\E|\Q{s}\E)", "")
    second = F.when(form == "psm", F.lit(s)).otherwise(F.lit(p))
    side = lambda x, mark, k: F.call_function("substring_index", x, mark, F.lit(k))
    first, rest = side(body, second, 1), side(body, second, -1)
    other, middle = side(rest, F.lit(m), 1), side(rest, F.lit(m), -1)
    return F.when(form == "psm", F.concat(first, middle, other)).when(form == "spm", F.concat(other, middle, first)).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle(load(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
k AS (SELECT doc_id, text, length(text) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
             ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM k),
p AS (SELECT *, substring(text, 1, a) AS prefix, substring(text, a + 1, b - a) AS middle, substring(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
