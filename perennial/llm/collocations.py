"""Phrase collocation mining: phrases that stand together more often than their parts would let one expect.

Texts are split into pieces at punctuation. Identical pieces of a language are made one with a multiplicity, first within
a task, then within the hash bucket of the piece; there their phrases are counted, weighted, by duckdb, which spills what
memory does not hold. Partial counts meet in the hash bucket of the phrase, where duckdb sums them up; only phrases
that reach `least` leave it. A phrase's parts are at least as frequent as the phrase, so all parts that are ever asked for
are among these. Each way to cut a candidate then sends a lookup request to where the counts of its parts are; a part
that very many candidates ask for is dealt out under `SALTS` keys, each asked for once. Counts, requests and answers
move by shuffles at every size; nothing is collected.

Rows between buckets travel as compressed runs, sorted by phrase. What duckdb spills lies in a folder of the task
that goes with it; a lost executor's tasks are done again.

Defined results: a null text is an empty one, a null language `und`; texts and pieces of any length are read whole (a long
piece is cut into runs of words that overlap by what a phrase needs, so that each occurrence counts once); bytes that are
no UTF-8 count as U+FFFD; ids are not looked at, so that repeated rows count as often as they are there; other columns
of any name are not looked at; an empty table, or one without a frequent phrase, gives no rows.
"""

from __future__ import annotations

import contextlib
import tempfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from .shared import partitions_for, small_batches, stored, table
from .textarrays import release

#: Bytes of text for each bucket of pieces, and for each bucket of phrases: so many that a bucket is counted in memory.
#: Beyond BUCKETS of them the runs between tasks would become too short; buckets then grow, and duckdb spills.
PIECE_BYTES, PHRASE_BYTES, BUCKETS = 12 << 20, 8 << 20, 1 << 15
#: What duckdb may hold in a task before it spills; rows of a batch of its answers.
MEMORY, ROWS = "384MB", 1 << 16
#: A piece of more bytes is cut into runs of so many words.
LONG_PIECE, RUN = 1 << 16, 4096
#: Under so many keys the requests for one part, and the rows of one language, are dealt out.
SALTS = 64
PACKED = "bucket int, rows binary"


@contextlib.contextmanager
def _engine():
    """A duckdb of one thread and bounded memory; what it spills goes with the block."""
    import duckdb

    with tempfile.TemporaryDirectory() as folder:
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder, "preserve_insertion_order": False})
        try:
            yield con
        finally:
            con.close()
            release()


def _insert(con, into: str, rows: pa.Table, select: str = "SELECT * FROM batch") -> None:
    con.register("batch", rows)
    con.execute(f"INSERT INTO {into} {select}")
    con.unregister("batch")


def _packed(con, sql: str):
    """The rows of a query whose first column is the bucket and that comes in its order, as compressed runs."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in con.sql(sql).fetch_record_batch(ROWS):
        numbers = batch.column(0)
        runs = pc.run_end_encode(numbers)
        buckets, sinks, lo = [], [], 0
        for bucket, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema(list(batch.schema)[1:]), options=options) as writer:
                writer.write_batch(pa.RecordBatch.from_arrays([c.slice(lo, hi - lo) for c in batch.columns[1:]], schema=pa.schema(list(batch.schema)[1:])))
            buckets.append(bucket)
            sinks.append(sink.getvalue().to_pybytes())
            lo = hi
        for k in range(0, len(sinks), 64):  # small batches: a run may be megabytes
            yield pa.RecordBatch.from_arrays([pa.array(buckets[k : k + 64], pa.int32()), pa.array(sinks[k : k + 64], pa.binary())], ["bucket", "rows"])


def _unpacked(batches):
    """Tables of about a megabyte or more, of the runs that came."""
    held, size = [], 0
    for batch in batches:
        for blob in batch.column("rows"):
            got = pa.ipc.open_stream(blob.as_buffer()).read_all()
            held.append(got)
            size += got.nbytes
            if size > 4 << 20:
                yield pa.concat_tables(held)
                held, size = [], 0
    if held:
        yield pa.concat_tables(held)


def _valid(texts: pa.Array) -> pa.Array:
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in texts.cast(pa.binary()).to_pylist()], pa.string())


def _runs_of(piece: str, longest: int):
    """(run of words, number of the words in it at which phrases start) of a long piece."""
    words = piece.replace("\t", " ").split(" ")
    words = [w for w in words if w]
    for k in range(0, len(words), RUN):
        yield " ".join(words[k : k + RUN + longest - 1]), min(RUN, len(words) - k)


def _pieces(buckets: int, longest: int):
    """Documents to packed pieces (language, piece, words at which phrases start, multiplicity)."""
    split = r"""SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM batch"""

    def run(batches):
        with _engine() as con:
            con.execute("CREATE TABLE p (lang VARCHAR, piece VARCHAR, own BIGINT, m BIGINT)")
            for batch in batches:
                rows = pa.Table.from_arrays([_valid(batch.column("lang")), _valid(batch.column("text"))], ["lang", "text"])
                con.register("batch", rows)
                con.execute(f"CREATE OR REPLACE TEMP TABLE s AS SELECT lang, piece, count(*) AS m FROM ({split}) WHERE trim(piece, ' ' || chr(9)) <> '' GROUP BY ALL")
                con.unregister("batch")
                con.execute(f"INSERT INTO p SELECT lang, piece, NULL, m FROM s WHERE strlen(piece) <= {LONG_PIECE}")
                for lang, piece, m in con.execute(f"SELECT * FROM s WHERE strlen(piece) > {LONG_PIECE}").fetchall():
                    parts = list(_runs_of(piece, longest))
                    _insert(con, "p", pa.table({"lang": pa.array([lang] * len(parts), pa.string()), "piece": pa.array([x for x, _ in parts], pa.large_string()), "own": pa.array([n for _, n in parts], pa.int64()), "m": pa.array([m] * len(parts), pa.int64())}))
            yield from _packed(con, f"SELECT CAST(hash(lang, piece) % {buckets} AS INTEGER) AS bucket, lang, piece, own, CAST(sum(m) AS BIGINT) AS m FROM p GROUP BY ALL ORDER BY ALL")

    return run


def _phrases(buckets: int, longest: int):
    """A bucket of packed pieces to packed partial counts (language, phrase, words, occurrences)."""

    def run(batches):
        with _engine() as con:
            con.execute("CREATE TABLE p (lang VARCHAR, piece VARCHAR, own BIGINT, m BIGINT)")
            for rows in _unpacked(batches):
                _insert(con, "p", rows)
            con.execute(r"CREATE TABLE q AS SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, own, m FROM (SELECT lang, piece, own, sum(m) AS m FROM p GROUP BY ALL)")
            con.execute("DROP TABLE p")
            for n in range(1, longest + 1):
                phrase = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
                places = f"SELECT lang, w, m, unnest(range(1, 1 + least(len(w) - {n - 1}, coalesce(own, len(w))))) AS i FROM q"
                counted = f"SELECT lang, phrase, CAST(sum(m) AS BIGINT) AS f FROM (SELECT lang, {phrase} AS phrase, m FROM ({places})) GROUP BY ALL"
                yield from _packed(con, f"SELECT CAST(hash(lang, phrase) % {buckets} AS INTEGER) AS bucket, lang, phrase, CAST({n} AS INTEGER) AS words, f FROM ({counted}) ORDER BY bucket, lang, phrase")

    return run


def _sums(least: int):
    """A bucket of packed partial counts to the phrases that reach `least`, and a row of no words for each language: the
    occurrences of all words of the bucket."""

    def run(batches):
        with _engine() as con:
            con.execute("CREATE TABLE c (lang VARCHAR, phrase VARCHAR, words INTEGER, f BIGINT)")
            for rows in _unpacked(batches):
                _insert(con, "c", rows)
            # A phrase without a space is a word, so the phrase says its number of words.
            frequent = f"SELECT lang, phrase, any_value(words) AS words, CAST(sum(f) AS BIGINT) AS f FROM c GROUP BY lang, phrase HAVING sum(f) >= {least}"
            total = "SELECT lang, NULL, 0, CAST(sum(f) AS BIGINT) FROM c WHERE words = 1 GROUP BY lang"
            yield from con.sql(f"{frequent} UNION ALL {total}").fetch_record_batch(ROWS)

    return run


def counts(docs: DataFrame, least: int = 10, longest: int = 3, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, phrase, words, f): phrases of 1 to `longest` words that occur `least` times or more in a language, and a row
    with a null phrase and words = 0 for each language and bucket, whose f add up to the language's words. Stored."""
    rows = small_batches(docs).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text")).where("text is not null")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    pieces, phrases = (min(BUCKETS, partitions_for(n_bytes, each)) for each in (PIECE_BYTES, PHRASE_BYTES))
    found = rows.mapInArrow(_pieces(pieces, longest), PACKED)
    found = found.repartitionById(pieces, F.col("bucket")).mapInArrow(_phrases(phrases, longest), PACKED)
    return stored(found.repartitionById(phrases, F.col("bucket")).mapInArrow(_sums(least), "lang string, phrase string, words int, f long"))


#: floor(1000000 a a / (l r)): exact in 38 digits, for counts below 10^16.
_SCORE = "(1000000 * cast(a as decimal(16,0)) * cast(a as decimal(16,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, words, a, l, r, score) of all phrases of two words and more: the cut with the lowest score counts, of
    equal ones the first."""
    known = counted.where("words > 0")
    asked = known.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    names = F.split("phrase", " ")
    sides = F.array(F.struct(F.lit("l").alias("side"), F.array_join(F.slice(names, F.lit(1), F.col("k")), " ").alias("part")), F.struct(F.lit("r").alias("side"), F.array_join(F.slice(names, F.col("k") + 1, F.col("words")), " ").alias("part")))
    asked = asked.withColumn("ask", F.explode(sides)).select("lang", "phrase", "words", "a", "k", "ask.side", "ask.part", F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)).alias("salt"))
    answers = asked.select("lang", "part", "salt").distinct().join(known.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cuts = asked.join(answers, ["lang", "part", "salt"]).groupBy("lang", "phrase", "words", "a", "k").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    best = cuts.withColumn("score", F.expr(_SCORE)).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "words", "a", "cut.l", "cut.r", "cut.score")


def whole(candidates: DataFrame, percent: int = 50) -> DataFrame:
    """Without candidates that stand inside a longer candidate which has `percent` of their occurrences or more."""
    names, words = F.split("phrase", " "), F.col("words")
    # All runs of 2 to words - 1 words of each candidate, each once.
    inner = F.flatten(F.transform(F.sequence(F.lit(2), words - 1), lambda n: F.transform(F.sequence(F.lit(1), words - n + 1), lambda i: F.array_join(F.slice(names, i, n), " "))))
    inside = candidates.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.join(most, ["lang", "phrase"], "left")
    return left.where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))).drop("longer")


def mine(docs: DataFrame, least: int = 10, longest: int = 3, percent: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """Per language the first `top` phrases by score: lang, rank, phrase, a (occurrences), l, r (of the two parts of the cut
    that counts), n (words of the language), score."""
    counted = counts(docs, least, longest, text, lang)
    kept = whole(stored(scored(counted)), percent)
    # A language's rows are ranked in SALTS groups before the first of them meet.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    within = Window.partitionBy("lang", "salt").orderBy(*order)
    first = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    words = counted.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))


ORACLE = {
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 4) t(k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM s GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
v AS (SELECT x.lang, x.k, x.phrase, x.a, x.w, x.cut, l.f AS l, r.f AS r, (CAST(1000000 AS HUGEINT) * x.a * x.a) // (CAST(l.f AS HUGEINT) * r.f) AS score
      FROM cuts x JOIN f l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.cut], ' ') JOIN f r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.cut + 1:x.k], ' ')),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank FROM b LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
}
QUERIES = {"op13_collocations": op13_collocations}
