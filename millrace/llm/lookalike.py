"""One consistent form for texts that look the same (problem 8).

Method: text is exploded to positioned code points, a broadcast mapping of decompositions and
look-alikes is joined, combining marks are ordered by their class, clusters are recomposed by a second
broadcast mapping, and the strings are rebuilt. Only texts with at least one character outside a
provably inert class take that way; for all others the form is the text itself. Those texts are first
distributed by id, and explode, join, window and both aggregations keep that distribution, so the
exploded rows are never shuffled.

Folded: width forms, ligatures and presentation forms, no-break and other typographic spaces,
invisible characters, canonical composition, look-alike letters of other scripts, non-breaking hyphens,
line-end styles and white space at line ends. Not folded, as they can be seen: letter case, accents,
raised and lowered figures, fractions, circled and styled letters, punctuation. A non-joiner between
Arabic letters and a joiner inside an emoji sequence change the picture and stay. Hangul jamo are left alone.

Defined cases: a null text has a null form; empty and blank texts keep an empty form and are in no
pair; repeated ids count once per distinct text; other columns are not read.
"""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.plans.runtime import checkpoint, spread

# Letters of other scripts and the Latin letters they look like.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ѵ": "v",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ү": "Y",
    # Greek
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian and Latin extensions
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "զ": "q", "ɡ": "g", "ɑ": "a",
    # Extended Arabic digits that are drawn like the common ones
    "۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩",
    # Hyphens
    "‐": "-", "‑": "-",
}
#: Decompositions a reader can see.
VISIBLE = ("<super>", "<sub>", "<circle>", "<square>", "<fraction>", "<font>")
#: Compatibility decompositions that are drawn the same (besides width, spacing and presentation forms).
SAME_COMPAT = {"℃", "℉", "…", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ", "ﬅ", "ﬆ", "Ĳ", "ĳ", "Ǉ", "ǈ", "ǉ", "Ǌ", "ǋ", "ǌ", "Ǳ", "ǲ", "ǳ", "µ", "№", "‼", "⁇", "⁈", "⁉", "′", "″"}
#: Pieces of a text's copies.
SALTS = 16
JOINERS = "\u200c\u200d"
BLOCKS = ((0x20, 0x24F), (0x600, 0x6FF), (0x2010, 0x2040), (0x20A0, 0x20BF))


def _steps(c: str) -> str:
    """One code point, mapped and fully decomposed."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    kind = unicodedata.category(c)
    if kind == "Zs":
        return " "
    if c in "\u2028\u2029\x85":
        return "\n"
    if c in JOINERS:
        return c
    if kind == "Cf" and not ("\u0600" <= c <= "\u0605" or c in "\u06dd\u070f") or 0xFE00 <= ord(c) <= 0xFE0F or 0xE0100 <= ord(c) <= 0xE01EF or c in "\u034f\u115f\u1160\u3164\uffa0\u180b\u180c\u180d":
        return ""
    if kind == "Cc" and c not in "\t\n\r":
        return ""
    d = unicodedata.decomposition(c)
    if not d or "가" <= c <= "힣":
        return c
    tag, parts = (d.split(" ", 1) + [""])[:2] if d[0] == "<" else ("", d)
    if tag in VISIBLE or tag == "<compat>" and c not in SAME_COMPAT and not 0xFB00 <= ord(c) <= 0xFB06:
        return c
    return "".join(_steps(chr(int(x, 16))) for x in parts.split())


@functools.cache
def mapping() -> tuple[dict[str, str], dict[str, str], str]:
    """Decompositions by code point, recompositions by cluster, and the inert characters as a regex class."""
    down, up = {}, {}
    for n in range(0x110000):
        if 0xD800 <= n < 0xE000:
            continue
        c = chr(n)
        s = _steps(c)
        if s != c or unicodedata.combining(c):
            down[c] = s
        if len(s) > 1 and unicodedata.decomposition(c)[:1] != "<" and unicodedata.normalize("NFC", s) == c:
            up[s] = c
    inert, runs = [], []
    for a, b in BLOCKS:
        for n in range(a, b + 1):
            c = chr(n)
            if c not in JOINERS and (c not in down or up.get(down[c]) == c and not unicodedata.combining(c)):
                inert.append(n)
    for n in [9, 10, 13, *inert]:
        if runs and runs[-1][1] == n - 1:
            runs[-1][1] = n
        else:
            runs.append([n, n])
    return down, up, "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def _tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Both mappings as DataFrames; their size is that of the Unicode tables, whatever the corpus."""
    down, up, _ = mapping()
    code = T.ArrayType(T.StructType([T.StructField("cp", T.StringType()), T.StructField("ccc", T.IntegerType())]))
    a = spark.createDataFrame([(c, [(x, unicodedata.combining(x)) for x in s]) for c, s in down.items()], T.StructType([T.StructField("cp", T.StringType()), T.StructField("seq", code)]))
    b = spark.createDataFrame(list(up.items()), "cluster string, composed string")
    return a, b


def fold_text(text: str) -> str:
    """The same form for one string, without Spark; for short lists such as evaluation items, and as the tests' model."""
    down, up, _ = mapping()
    text = _lines(_joiners(text))
    out, cluster = [], []
    for c in "".join(down.get(c, c) for c in text) + "\0":
        if not unicodedata.combining(c):  # a starter begins a cluster, and sorts first within it
            s = "".join(sorted(cluster, key=unicodedata.combining))
            out.append(up.get(s) or up.get(s[:2], s[:2]) + s[2:])
            cluster = []
        cluster.append(c)
    return _lines("".join(out)).strip(" \t\n")


# Contexts in which a joiner is seen, as patterns that both engines read alike.
_LOOSE_JOINER = "(?<![ؠ-ۿ])\u200c|\u200c(?![ؠ-ۿ])|(?<![☀-➿\ufe0f\U0001f000-\U0001faff])\u200d|\u200d(?![☀-➿\U0001f000-\U0001faff])"
_LINE_END = "[ \t]*(?:\r\n?|\n)"


def _joiners(text: str) -> str:
    import re

    return re.sub(_LOOSE_JOINER, "", text)


def _lines(text: str) -> str:
    import re

    return re.sub(_LINE_END, "\n", text)


def canonical(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, text, form)``: every input row with the canonical form of its text."""
    spark = df.sparkSession
    inert = mapping()[2]
    rows = spread(df.select(F.col(id_col), F.col(text_col).cast("string").alias("text")))
    # the two commonest runs go first, as a class of many ranges costs far more per character
    rest = F.regexp_replace(F.regexp_replace("text", "[\t\n\r -~]+", ""), "[ء-غف-ي]+", "")
    active = rest.rlike(f"[^{inert}]")
    tidy = lambda c: F.regexp_replace(F.regexp_replace(c, _LINE_END, "\n"), "^[ \t\n]+|[ \t\n]+\\z", "")
    plain = rows.where(F.col("text").isNull() | ~active).select(id_col, "text", tidy(F.col("text")).alias("form"))

    down, up = _tables(spark)
    # a text that stands under several ids is folded at most SALTS times, so that its copies are not one task's join
    # (there may be a third of all rows of them); the key also makes repeated ids harmless
    hot = rows.where(active).withColumn("__k", F.concat(F.md5("text"), F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("string")))
    distinct = hot.groupBy("__k").agg(F.first("text").alias("text"))
    # every code point gets its position; a run of inert ones that no mark can follow stays one piece
    points = distinct.select("__k", F.posexplode(F.regexp_extract_all(F.regexp_replace("text", _LOOSE_JOINER, ""), F.lit(f"[{inert}]+(?![^{inert}])|(?s)."), F.lit(0))).alias("pos", "cp"))
    mapped = points.join(F.broadcast(down), "cp", "left").select("__k", "pos", F.posexplode(F.coalesce("seq", F.array(F.struct("cp", F.lit(0).alias("ccc"))))).alias("sub", "x")).select("__k", "pos", "sub", "x.cp", "x.ccc")
    at = Window.partitionBy("__k").orderBy("pos", "sub")
    numbered = mapped.withColumn("base", F.sum((F.col("ccc") == 0).cast("int")).over(at))
    # each row that starts a cluster is followed by its marks; clusters of one code point need no join
    marks = Window.partitionBy("__k", "base").orderBy("ccc", "pos", "sub").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cluster = numbered.withColumn("cluster", F.array_join(F.collect_list("cp").over(marks), "")).withColumn("n", F.row_number().over(Window.partitionBy("__k", "base").orderBy("ccc", "pos", "sub"))).where("n = 1")
    # a cluster that is no character as a whole is composed as far as its first mark
    head = F.broadcast(up.select(F.col("cluster").alias("head"), F.col("composed").alias("begun")))
    joined = cluster.join(F.broadcast(up), "cluster", "left").withColumn("head", F.when(F.length("cluster") > 2, F.substring("cluster", 1, 2))).join(head, "head", "left")
    rest = F.concat("begun", F.substring("cluster", F.lit(3), F.length("cluster")))
    composed = joined.select("__k", "base", F.coalesce("composed", rest, "cluster").alias("s"))
    rebuilt = composed.groupBy("__k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "s"))), lambda x: x["s"]), "").alias("__form"))
    folded = hot.join(rebuilt, "__k", "left").select(id_col, "text", tidy(F.coalesce("__form", F.lit(""))).alias("form"))
    return plain.unionByName(folded)


def _classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, fk, tk)``: hashes of form and text of every row with an id and visible characters, written once (40 bytes a row)."""
    forms = canonical(df, id_col, text_col).where("form <> ''")
    return checkpoint(forms.select(F.col(id_col).alias("id"), F.unhex(F.md5("form")).alias("fk"), F.unhex(F.md5("text")).alias("tk")).where("id is not null").distinct())


def same_look_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, links)``: every row of a class with several stored texts, its class (the smallest id in it), and the
    number of rows in the class whose stored text differs. One row a document whatever the size of a class."""
    keys = _classes(df, id_col, text_col)
    texts = keys.groupBy("fk", "tk").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    whole = texts.groupBy("fk").agg(F.sum("n").alias("total"), F.min("first").alias("class_id"), F.count("*").alias("texts")).where("texts > 1")
    links = texts.join(whole, "fk").select("fk", "tk", "class_id", (F.col("total") - F.col("n")).alias("links"))
    # the copies of one text are joined in pieces, each with its own row of the class
    piece = F.pmod(F.xxhash64("id"), F.lit(SALTS))
    split = links.withColumn("__piece", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("__piece", F.col("__piece").cast("long"))
    return keys.withColumn("__piece", piece).join(split, ["fk", "tk", "__piece"]).select(F.col("id").alias(id_col), "class_id", "links")


def same_look_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_a, id_b)``, smaller id first: rows whose stored texts differ while their forms are equal.

    All pairs of a class are its result here, so its size is that of the square of the class; :func:`same_look_classes`
    has the same links in one row a document. The texts of a class are paired first, then their rows; the
    rows of one text come in ``SALTS`` pieces, so a class that holds many rows is the work of many tasks.
    """
    keys = _classes(df, id_col, text_col)
    texts = keys.groupBy("fk", "tk").agg(F.lit(1).alias("__one"))
    several = texts.groupBy("fk").agg(F.count("*").alias("texts")).where("texts > 1").select("fk")
    some = keys.join(several, "fk", "left_semi")
    kinds = some.groupBy("fk", "tk").agg(F.lit(1).alias("__one")).select("fk", "tk")
    of = lambda c: kinds.select("fk", F.col("tk").alias(c))
    other = of("ta").join(of("tb"), "fk").where("ta < tb").select("ta", "tb")
    pieces = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    first = some.select(F.col("tk").alias("ta"), F.col("id").alias("x"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("p"))
    met = other.withColumn("p", pieces).join(first, ["ta", "p"]).select("tb", "x").withColumn("p", pieces)
    second = some.select(F.col("tk").alias("tb"), F.col("id").alias("y"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("p"))
    pairs = met.join(second, ["tb", "p"]).where("x <> y")
    return pairs.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).distinct()
