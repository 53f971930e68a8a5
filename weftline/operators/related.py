"""Files that import one another, and the chunks that come along with a hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_FILES, CHUNKS_PER_FILE = 3, 5
#: The forms of reference that are understood. Each has one group: the target.
IMPORTS = (
    r"from\s+([\p{L}\p{N}_.]+)\s+import",
    r"import\s+([\p{L}\p{N}_.]+)",
    r"require\(['\"]([^'\"]+)['\"]\)",
    r"import\s+.*from\s+['\"]([^'\"]+)['\"]",
)


def import_edges(chunks: DataFrame) -> DataFrame:
    """(file_path, related_file): distinct references of files to others; dots of a target become slashes."""
    found = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(p), F.lit(1)) for p in IMPORTS)))
    named = chunks.where("file_path <> ''").select("file_path", F.explode(found).alias("target"))
    return named.select("file_path", F.translate("target", ".", "/").alias("related_file")).where("related_file <> file_path").distinct()


def related_files(starts: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """(start, file, depth): files within ``depth`` references of each start (column ``file``), the start included, at least depth."""
    reached = starts.select(F.col("file").alias("start"), "file").distinct().withColumn("depth", F.lit(0))
    frontier = reached
    for d in range(1, depth + 1):
        onward = frontier.join(edges, frontier.file == edges.file_path).select("start", F.col("related_file").alias("file")).distinct()
        frontier = onward.join(reached, ["start", "file"], "left_anti").withColumn("depth", F.lit(d))
        reached = reached.unionByName(frontier)
    return reached


def chunk_file(path: str = "file_path", source: str = "source") -> F.Column:
    """The file that a chunk belongs to: its path, else its source, else 'unknown'."""
    return F.coalesce(F.nullif(F.col(path), F.lit("")), F.col(source), F.lit("unknown"))


def chunks_by_file(chunks: DataFrame) -> DataFrame:
    """(file, chunk_ids): sorted ids of each file's chunks."""
    return chunks.groupBy(chunk_file().alias("file")).agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))


def expand(hits: DataFrame, chunks: DataFrame, max_files: int = MAX_FILES, per_file: int = CHUNKS_PER_FILE) -> DataFrame:
    """``hits`` (query_id, chunk_id, rank) and the first chunks of the first related files, by name: query_id, chunk_id, rank, is_related.

    The files of the hits are among their related files. Related rows have no rank. Queries none of whose hits has a
    file path are not expanded.
    """
    placed = chunks.select("chunk_id", "file_path", chunk_file().alias("file"))
    at = hits.join(placed, "chunk_id")
    coded = at.where("file_path <> ''").select("query_id").distinct()
    starts = at.join(coded, "query_id", "left_semi").select("query_id", "file").distinct()
    reach = related_files(starts.select("file").distinct(), import_edges(chunks), 1)
    reach = reach.select(F.col("start").alias("file"), F.col("file").alias("reached"))
    files = starts.join(reach, "file").select("query_id", F.col("reached").alias("file")).distinct()
    by_name = Window.partitionBy("query_id").orderBy("file")
    files = files.withColumn("n", F.row_number().over(by_name)).where(F.col("n") <= max_files)
    in_file = Window.partitionBy("file").orderBy("chunk_id")
    first = placed.withColumn("n", F.row_number().over(in_file)).where(F.col("n") <= per_file).select("file", "chunk_id")
    more = files.select("query_id", "file").join(first, "file").select("query_id", "chunk_id").distinct()
    more = more.join(hits, ["query_id", "chunk_id"], "left_anti")
    return hits.select("query_id", "chunk_id", "rank", F.lit(False).alias("is_related")).unionByName(
        more.select("query_id", "chunk_id", F.lit(None).cast("int").alias("rank"), F.lit(True).alias("is_related"))
    )
