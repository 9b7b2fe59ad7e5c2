"""Line dedup by content-defined chunks of lines; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.session import discard, free_names, materialize, row_key, table

#: A line may begin a chunk where the rolling hash over it and the line before is below CUT, of MODULUS values.
CUT, MODULUS = 4, 13
_KEY = ["k1", "k2"]


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_chunks(text: Column) -> Column:
    """Array of (k, lines) chunks of two lines or more; a text of one line is one chunk.

    The rolling hash of lines i - 1 and i makes line i a candidate. A chunk begins at a candidate after a line that
    is none, but not at the last line, so that no chunk has one line. A boundary depends on the three lines around
    it only: it stays where it is when lines shift, and a run of equal lines is never cut up.
    """

    def hashed(lines: Column) -> Column:
        return F.transform(F.transform(lines, lambda x: F.md5(x)), lambda m: F.ascii(m) * 128 + F.ascii(F.substring(m, 2, 1)))

    def cut(lines: Column) -> Column:
        def flags(h: Column) -> Column:
            return F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h)), lambda a, b: (a * 31 + b * 17 + a * b) % MODULUS < CUT)

        def begins(f: Column) -> Column:
            # f[i - 1] tells whether line i is a candidate; line 0 counts as one
            found = F.transform(f, lambda c, i: F.when(c & (i < F.size(f) - 1) & ~F.when(i == 0, True).otherwise(F.get(f, i - 1)), i + 1))
            return F.concat(F.array(F.lit(0)), F.filter(found, lambda i: i.isNotNull()))

        def parts(starts: Column) -> Column:
            return F.transform(starts, lambda a, k: F.struct(k.alias("k"), F.slice(lines, a + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - a).alias("lines")))

        return _let(_let(_let(hashed(lines), flags), begins), parts)

    return _let(_lines(text), cut)


def _chunk_text(chunk: Column) -> Column:
    return F.array_join(chunk["lines"], "\n")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """``docs`` with two key columns, (void, k1, k2, text) of its rows, and the names of the key columns."""
    names = free_names(docs, *_KEY)
    rows = docs.withColumns(dict(zip(names, row_key(id_col, text_col), strict=True)))
    return rows, rows.select(F.col(id_col).isNull().alias("void"), *(F.col(n).alias(k) for n, k in zip(names, _KEY, strict=True)), F.col(text_col).alias("text")), names


def _first_of_each(marks: DataFrame) -> DataFrame:
    """(digest, first) of the digests that stand in several places; a written table, so that the planner can split
    the rows of a very common digest when they are joined with it."""
    firsts = marks.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("void", *_KEY, "k")).alias("first")).where("n > 1")
    return materialize(firsts.select("digest", "first"), "firsts")


def _own_first() -> Column:
    return (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.k") == F.col("k"))


def _heads(pieces: DataFrame) -> DataFrame:
    return materialize(pieces.where("is_first").groupBy("digest").agg(F.min("bytes").alias("head")), "heads")


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` with two more columns, and their names: the number of chunks, and the numbers of chunks
    that stand earlier too (null: none).

    Chunks are counted by MD5, as hashes only. Chunks with a repeated digest are then compared byte by byte with
    the first one, in order of id and place, and only equal ones go.
    """
    rows, whole, names = _keyed(docs, id_col, text_col)
    # of each chunk its number and digest: small rows, made once
    parts = whole.select("void", *_KEY, F.explode(line_chunks(F.col("text"))).alias("c"))
    marks = materialize(parts.select("void", *_KEY, F.col("c.k").alias("k"), F.when(F.size("c.lines") > 1, F.unhex(F.md5(_chunk_text(F.col("c"))))).alias("digest")), "marks")
    firsts = _first_of_each(marks.where("digest is not null"))
    listed = marks.join(firsts, "digest").groupBy(*_KEY).agg(F.collect_set(F.struct("k", _own_first().alias("is_first"))).alias("suspects"))
    # texts of the suspects, cut out of each text once
    with_text = whole.dropDuplicates(_KEY).join(listed.hint("shuffle_hash"), _KEY)
    numbers = F.transform("suspects", lambda s: s["k"])
    cut = with_text.select(*_KEY, F.map_from_entries("suspects").alias("known"), F.explode(F.filter(line_chunks(F.col("text")), lambda c: F.array_contains(numbers, c["k"]))).alias("c"))
    pieces = cut.select(*_KEY, F.col("c.k").alias("k"), F.element_at("known", F.col("c.k")).alias("is_first"), _chunk_text(F.col("c")).alias("bytes")).withColumn("digest", F.unhex(F.md5("bytes")))
    heads = _heads(pieces)
    same = pieces.where("not is_first").join(heads, "digest").where("bytes = head").select(*_KEY, F.lit(None).cast("int").alias("k"), F.col("k").alias("gone"))
    count, gone = free_names(rows, "chunks", "gone")
    facts = same.union(marks.select(*_KEY, "k", F.lit(None).cast("int"))).groupBy(*_KEY).agg((F.max("k") + 1).alias(count), F.collect_set("gone").alias(gone))
    facts = materialize(facts.withColumn(gone, F.when(F.size(gone) > 0, F.col(gone))), "gone")
    discard(marks, firsts, heads)
    return rows.join(facts.withColumnsRenamed(dict(zip(_KEY, names, strict=True))).hint("shuffle_hash"), names, "left").drop(*names), count, gone


def repeated_lines(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with one more column, and its name: numbers of lines in a later copy of a block (null: none).

    A block is two adjacent lines, so each longer block is found whole, wherever it begins and ends. Blocks are
    counted by MD5; those with a repeated digest are then compared byte by byte with the first one, in order of id and
    place. Of a copy that overlaps the first one, only the line beyond it goes.
    """
    rows, whole, names = _keyed(docs, id_col, text_col)
    digests = _let(_lines(F.col("text")), lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda a, b: F.unhex(F.md5(F.concat(a, F.lit("\n"), b)))))
    marks = materialize(whole.select("void", *_KEY, F.posexplode(digests).alias("k", "digest")), "marks")
    firsts = _first_of_each(marks)
    overlaps = (F.col("first.k1") == F.col("k1")) & (F.col("first.k2") == F.col("k2")) & (F.col("first.k") + 1 == F.col("k"))
    listed = marks.join(firsts, "digest").groupBy(*_KEY).agg(F.collect_set(F.struct("k", "digest", _own_first().alias("is_first"), overlaps.alias("overlaps"))).alias("suspects"))
    with_text = whole.dropDuplicates(_KEY).join(listed.hint("shuffle_hash"), _KEY)
    cut = _let(_lines(F.col("text")), lambda x: F.transform("suspects", lambda s: F.struct(*(s[c].alias(c) for c in ("k", "digest", "is_first", "overlaps")), F.concat(x[s["k"]], F.lit("\n"), x[s["k"] + 1]).alias("bytes"))))
    pieces = with_text.select(*_KEY, F.explode(cut).alias("c")).select(*_KEY, "c.*")
    heads = _heads(pieces)
    same = pieces.where("not is_first").join(heads, "digest").where("bytes = head")
    numbers = F.explode(F.when(F.col("overlaps"), F.array(F.col("k") + 1)).otherwise(F.array(F.col("k"), F.col("k") + 1)))
    (gone,) = free_names(rows, "gone")
    found = materialize(same.select(*_KEY, numbers.alias("i")).groupBy(*_KEY).agg(F.collect_set("i").alias(gone)), "gone")
    discard(marks, firsts, heads)
    return rows.join(found.withColumnsRenamed(dict(zip(_KEY, names, strict=True))).hint("shuffle_hash"), names, "left").drop(*names), gone


def _left(text: Column, gone: str) -> Column:
    """The text without the lines whose numbers are in ``gone``."""
    return F.array_join(F.filter(_lines(text), lambda x, i: ~F.array_contains(gone, i)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without blocks of two or more lines that stand in an earlier place.

    Earlier is by id, then by place in the text; the first one stays. Rows with the same id and text are one
    document. Null texts stay null, null ids come last; a text may become empty. Other columns stay.
    """
    out, gone = repeated_lines(docs, id_col, text_col)
    return out.withColumn(text_col, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(_left(F.col(text_col), gone))).select(*docs.columns)


def report_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_removed and kept_sha256 of the text that ``dedup_lines`` leaves; null is empty."""
    out, gone = repeated_lines(docs.select(id_col, text_col), id_col, text_col)
    kept = F.when(F.col(gone).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(_left(F.col(text_col), gone))
    return out.select(F.col(id_col).cast("long").alias(id_col), F.size(_lines(F.col(text_col))).cast("long").alias("n_lines"), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"), F.sha2(kept, 256).alias("kept_sha256"))


def report_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_lines, n_chunks, n_removed (lines) and kept_sha256 when only whole repeated chunks go.

    Null is the empty text, one line. Rows with the same id and text are one document; null ids come last. An empty
    table gives no rows; other columns are ignored. Blocks that fill no chunk and the edges of longer ones stay;
    ``report_lines`` finds them.
    """
    out, count, gone = repeated_chunks(docs.select(id_col, text_col), id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    left = F.when(F.col(gone).isNotNull(), F.flatten(F.transform(F.filter(line_chunks(text), lambda c: ~F.array_contains(gone, c["k"])), lambda c: c["lines"])))
    out = out.select(F.col(id_col).cast("long").alias(id_col), text.alias("t"), F.size(_lines(text)).alias("n"), F.col(count).alias("c"), left.alias("l"))
    return out.select(id_col, F.col("n").cast("long").alias("n_lines"), F.col("c").cast("long").alias("n_chunks"), F.when(F.col("l").isNull(), 0).otherwise(F.col("n") - F.size("l")).cast("long").alias("n_removed"), F.sha2(F.when(F.col("l").isNull(), F.col("t")).otherwise(F.array_join("l", "\n")), 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 as its SQL has it: repeated chunks of lines of all documents."""
    return report_chunks(table(spark, sf_dir, "documents"))


def whole_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7 without chunks: all repeated blocks of two or more lines of all documents."""
    return report_lines(table(spark, sf_dir, "documents"))


SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
h AS (SELECT *, CAST(ascii(md5(line)) * 128 + ascii(substr(md5(line), 2, 1)) AS BIGINT) AS h FROM l),
f AS (SELECT *, lag(h) OVER w IS NULL OR (lag(h) OVER w * 31 + h * 17 + lag(h) OVER w * h) % {MODULUS} < {CUT} AS f,
             lead(h) OVER w IS NULL AS last FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
b AS (SELECT *, f AND NOT last AND NOT coalesce(lag(f) OVER (PARTITION BY doc_id ORDER BY i), true) AS cut FROM f),
n AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b),
c AS (SELECT doc_id, k, count(*) AS m, string_agg(line, chr(10) ORDER BY i) AS body FROM n GROUP BY doc_id, k),
r AS (SELECT *, CASE WHEN m > 1 THEN row_number() OVER (PARTITION BY body, m > 1 ORDER BY doc_id, k) ELSE 1 END AS nth FROM c)
SELECT doc_id, CAST(sum(m) AS BIGINT) AS n_lines, count(*) AS n_chunks,
       CAST(sum(CASE WHEN nth > 1 THEN m ELSE 0 END) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY k) FILTER (nth = 1), '')) AS kept_sha256
FROM r GROUP BY doc_id
"""

WHOLE_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
p AS (SELECT doc_id, i, line || chr(10) || lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS body FROM l),
r AS (SELECT doc_id, i, row_number() OVER w AS nth, first_value(doc_id) OVER w AS d, first_value(i) OVER w AS f
      FROM p WHERE body IS NOT NULL WINDOW w AS (PARTITION BY body ORDER BY doc_id, i)),
g AS (SELECT doc_id, i + 1 AS i FROM r WHERE nth > 1 UNION SELECT doc_id, i FROM r WHERE nth > 1 AND NOT (doc_id = d AND i = f + 1)),
k AS (SELECT l.doc_id, l.i, l.line, g.i IS NOT NULL AS gone FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
