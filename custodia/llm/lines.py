"""Line dedup with column expressions only: explode normalised lines, hash, count documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.llm.common import UPPER, WHITE


def normalised(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.btrim(line, F.lit(WHITE))


def _marks(key: Column) -> list[Column]:
    """128 bits of a key: two hashes of different seeds."""
    folded = F.translate(key, UPPER, UPPER.lower())
    return [F.xxhash64(folded).alias("h1"), F.xxhash64(F.lit(1), folded).alias("h2")]


def drop_repeated_lines(
    docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 40, min_docs: int = 5
) -> DataFrame:
    """docs with the repeated lines taken out of `text`, and with __n_lines and __n_dropped added.

    Lines are parted by newline. A line's key is the line stripped of ASCII white space with A-Z lower-cased. A key of at least `min_chars`
    code points that occurs in at least `min_docs` documents (distinct ids) loses its lines everywhere but in the largest id holding it.

    A null text counts as one empty line and becomes an empty text. Rows with a null id keep all lines and count for no key. Repeated rows
    are treated alike and count as one document. All other columns pass through; names starting with __ are reserved.

    The first shuffle holds 32 bytes for each long line, spread over (key, document); counts combine before the second. The join that marks
    lines to drop is an inner equi-join, so a line found in a third of all documents is split by adaptive execution. Texts move once, to
    meet the positions to drop.
    """
    rows = docs.withColumns(
        {"__mark": F.xxhash64(F.col(f"`{text}`")), "__lines": F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)}
    )
    key = normalised(F.col("line"))
    long_lines = (
        docs.where(F.col(f"`{id}`").isNotNull())
        .select(
            F.col(f"`{id}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark"),
            F.posexplode(F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\n", -1)).alias("pos", "line"),
        )
        .where((F.char_length("line") >= min_chars) & (F.char_length(key) >= min_chars))
        .select("id", "mark", "pos", *_marks(key))
    )
    repeated = (
        long_lines.groupBy("h1", "h2").agg(F.count_distinct("id").alias("holders"), F.max("id").alias("keeper"))
        .where(F.col("holders") >= min_docs).select("h1", "h2", "keeper")
    )
    drops = (
        long_lines.join(repeated, ["h1", "h2"]).where("id <> keeper")
        .groupBy(F.col("id").alias("__id"), F.col("mark").alias("__mark")).agg(F.collect_set("pos").alias("__drop"))
    )
    joined = rows.withColumn("__id", F.col(f"`{id}`")).join(drops, ["__id", "__mark"], "left")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.coalesce("__drop", F.array().cast("array<int>"))), lambda i: F.get("__lines", i))
    joined = joined.withColumns(
        {"__text": F.array_join(kept, "\n"), "__n_lines": F.size("__lines").cast("long"), "__n_dropped": F.coalesce(F.size("__drop"), F.lit(0)).cast("long")}
    )
    return joined.select(
        *[(F.col("__text") if name == text else F.col(f"`{name}`")).alias(name) for name in docs.columns], "__n_lines", "__n_dropped"
    )


#: The same in SQL, for the columns of the line dedup query.
KEPT_LINES_SQL = f"""
select doc_id, text, pos, line,
       translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{UPPER.lower()}') as key
from (select doc_id, text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
             generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from {{docs}})
"""


def line_dedup_sql(docs: str) -> str:
    """DuckDB: (doc_id, n_lines, n_dropped, kept) of a relation with one row per doc_id."""
    return f"""
with lines as ({KEPT_LINES_SQL.format(docs=docs)}),
repeated as (select key, max(doc_id) as keeper from lines where length(key) >= 40 group by key having count(distinct doc_id) >= 5)
select doc_id, count(*) as n_lines, count(*) filter (keeper is not null and doc_id <> keeper) as n_dropped,
       coalesce(string_agg(line, chr(10) order by pos) filter (keeper is null or doc_id = keeper), '') as kept
from lines left join repeated using (key) group by doc_id"""
