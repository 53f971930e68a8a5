"""Secrets, told from examples by who owns them (DataFrame functions only).

Patterns propose candidates in every text. A credential that is live sits with one owner; one that stands in many owners'
repositories is an example, a test value or a published checksum. So the SHA-256 of each candidate's value is aggregated
over the whole corpus by distinct repositories and owners, and each candidate gets a verdict:

* ``copied``: ``WIDE_OWNERS`` owners or ``WIDE_REPOSITORIES`` repositories or more have it;
* ``live``: it is not, and looks random: letters and digits and at least ``DISTINCT`` different characters;
* ``weak``: neither.

Base spans are returned whatever the verdict. Spans of the other kinds, whose patterns alone say little, are added only
where they are live.

Only digests leave the scan of the texts. Occurrences are summed by (value, owner, repository) on the map side, then twice
more, so that a value with a third of all occurrences is no hot task. For the way back, values with more than one in
``HEAVY_SHARE`` of all occurrences, of which there are fewer than ``HEAVY_SHARE``, are broadcast; the rest, none of them
frequent, is joined by an ordinary shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import bound, running
from weftline.llm.shared import documents, text_or_empty, written

#: Owners, or repositories, that make a value a copied one.
WIDE_OWNERS, WIDE_REPOSITORIES = 3, 5
#: Different characters of a value that looks random, at least.
DISTINCT = 10
#: Values with more than this fraction of all occurrences are broadcast.
HEAVY_SHARE = 1000


@dataclass(frozen=True)
class Kind:
    """One kind of candidate: its pattern, which of the pattern's groups is the value, the value's least length, a cheap test of texts."""

    name: str
    pattern: str
    plain: str
    group: int
    least: int
    hint: Callable[[Column], Column]
    base: bool = True


def _either(word: str) -> str:
    """A pattern for the word in either case; case flags differ between engines."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_CLASS = "A-Za-z0-9+/_.=-"

#: In the order in which equal starts are listed. ``plain`` is the pattern without possessive forms and look-behind: the same
#: matches, since a run is taken whole by the first attempt on it.
KINDS = (
    Kind("assign", rf"""({_NAMES})["']?+\x20*+[:=]\x20*+["']?+([{_CLASS}]++)""", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([{_CLASS}]+)""", 2, 12, lambda t: t.rlike(_NAMES)),
    Kind("access", r"AKIA[A-Z0-9]++", "AKIA[A-Z0-9]+", 0, 18, lambda t: F.contains(t, F.lit("AKIA"))),
    Kind("hex", r"(?<![0-9a-f])[0-9a-f]{16,}+", "[0-9a-f]{16,}", 0, 16, lambda t: t.rlike("[0-9a-f]{16}")),
    Kind("issued", r"(?:gh[opsu]_|glpat-|xox[abp]-|[sp]k_live_|eyJ)[A-Za-z0-9_.-]++", r"(?:gh[opsu]_|glpat-|xox[abp]-|[sp]k_live_|eyJ)[A-Za-z0-9_.-]+", 0, 20, lambda t: t.rlike("gh[opsu]_|glpat-|xox[abp]-|[sp]k_live_|eyJ"), base=False),
    Kind("key", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+", "[A-Za-z0-9+/_=-]{24,}", 0, 24, lambda t: t.rlike("[A-Za-z0-9+/_=-]{24}"), base=False),
)

_EMPTY = "CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,value:binary,random:boolean>>)"


def _looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT)


def candidates(text: Column, rank: int, kind: Kind) -> Column:
    """The candidates of one kind: array of (start, rank, end, kind, value, random); value is a digest, end exclusive.

    ``split`` gives the pieces between matches and ``regexp_extract_all`` the matches, both by one scan from the left; places
    follow from their lengths, in linear time.
    """

    def placed(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: F.length(p["piece"]) + F.length(p["match"])), lambda a, x: a + x)
        return F.zip_with(pairs, before, found)

    def found(pair: Column, before: Column) -> Column:
        start = before + F.length(pair["piece"])
        value = pair["value"]
        return F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(pair["match"])).alias("end"), F.lit(kind.name).alias("kind"),
            F.when(F.length(value) >= kind.least, F.unhex(F.sha2(value, 256))).alias("value"), _looks_random(value).alias("random"),
        )

    def paired(piece: Column, match: Column) -> Column:
        value = F.regexp_extract(match, kind.pattern, kind.group) if kind.group else match
        return F.struct(piece.alias("piece"), match.alias("match"), value.alias("value"))

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = bound(matches, lambda ms: F.zip_with(F.slice(F.split(text, kind.pattern, -1), F.lit(1), F.size(ms)), ms, paired))
    return F.when(kind.hint(text), F.filter(bound(pairs, placed), lambda s: s["value"].isNotNull())).otherwise(F.expr(_EMPTY))


def scan(docs: DataFrame, id_col: str, text_col: str, repository: Column, owner: Column) -> DataFrame:
    """(row, doc_id, repository, owner, found): the candidates of each row, in order; a written table without texts or values."""
    text = docs.select(F.col(id_col).alias("doc_id"), repository.alias("repository"), owner.alias("owner"), text_or_empty(text_col).alias("text"))
    found = F.array_sort(F.concat(*(candidates(F.col("text"), i, k) for i, k in enumerate(KINDS))))
    return written(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "repository", "owner", found.alias("found")), "secret-scan")  # written: the numbers stay


def ownership(each: DataFrame) -> DataFrame:
    """(value, occurrences, repositories, owners) of each value; ``each`` has value, repository, owner. A repository is one of its owner."""
    each = each.groupBy("value", "owner", "repository").agg(F.count("*").alias("occurrences"))
    by_owner = each.groupBy("value", "owner").agg(F.sum("occurrences").alias("occurrences"), F.count("*").alias("repositories"))
    return by_owner.groupBy("value").agg(F.sum("occurrences").alias("occurrences"), F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def verdict(repositories: Column, owners: Column, random: Column) -> Column:
    """What the spread and the look of a value say."""
    copied = (owners >= WIDE_OWNERS) | (repositories >= WIDE_REPOSITORIES)
    return F.when(copied, "copied").when(random, "live").otherwise("weak")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository: Column | None = None, owner: Column | None = None) -> DataFrame:
    """One row per input row: doc_id and its spans in order, an array of (start, rank, end, kind, verdict, repositories, owners).

    ``repository`` defaults to the column source, ``owner`` to what stands before the repository's last slash, or all of it.
    Null texts have no spans. Null repositories and owners are one of their own. Ids may be null or repeat; rows
    are told apart by number. Columns of any other name are not read. An empty table gives no rows.
    """
    repository = F.col("source").cast("string") if repository is None else repository
    owner = F.regexp_replace(repository, "/[^/]*$", "") if owner is None else owner
    scanned = scan(docs, id_col, text_col, repository, owner)
    each = scanned.where(F.size("found") > 0).select("row", "repository", "owner", F.explode("found").alias("s"))
    known = written(ownership(each.select(F.col("s.value").alias("value"), "repository", "owner")), "secret-owners")
    total = known.agg(F.sum("occurrences")).first()[0] or 0

    heavy = F.col("occurrences") * HEAVY_SHARE > total
    spans = each.select("row", "s", F.col("s.value").alias("value"))
    often = F.broadcast(known.where(heavy))  # fewer than HEAVY_SHARE rows
    judged = spans.join(often, "value").unionByName(spans.join(often.select("value"), "value", "left_anti").join(known.where(~heavy), "value"))
    said = verdict(F.col("repositories"), F.col("owners"), F.col("s.random"))
    span = F.struct("s.start", "s.rank", "s.end", "s.kind", said.alias("verdict"), "repositories", "owners")
    base = F.col("s.kind").isin([k.name for k in KINDS if k.base])
    by_row = judged.where(base | (said == "live")).groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return scanned.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _number(name: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")


def query(spark, sf_dir):
    """op12: every whole text of ``documents``; a document's source is its repository."""
    found = find_secrets(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["rank"] < sum(k.base for k in KINDS))
    return found.select(
        "doc_id",
        *(_number(k.name) for k in KINDS if k.base),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["verdict"]), ",").alias("verdicts"),
        F.array_join(F.transform("spans", lambda s: s["owners"].cast("string")), ",").alias("owners"),
    )


def _oracle() -> str:
    parts = []
    for rank, k in enumerate(KINDS):
        p = k.plain.replace("'", "''")
        parts.append(f"""
SELECT doc_id, source, {rank} AS rank, '{k.name}' AS kind, {str(k.base).lower()} AS base, e - length(m) AS s, e, regexp_extract(m, '{p}', {k.group}) AS v
FROM (
  SELECT doc_id, source, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))::BIGINT AS e
  FROM (SELECT doc_id, source, ps, ms, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, source, string_split_regex(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms FROM d))
) WHERE length(regexp_extract(m, '{p}', {k.group})) >= {k.least}""")
    listed = "coalesce(string_agg({}, ',' ORDER BY s, rank) {}, '')"
    place = "kind || ':' || s || ':' || e"
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    some = "FILTER (kind IS NOT NULL)"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
each AS ({" UNION ALL ".join(parts)}),
spread AS (SELECT v, count(*) AS repositories, count(DISTINCT o) AS owners FROM (SELECT DISTINCT v, coalesce(source, chr(0)) AS r, regexp_replace(coalesce(source, chr(0)), '/[^/]*$', '') AS o FROM each) GROUP BY v),
said AS (SELECT *, CASE WHEN owners >= {WIDE_OWNERS} OR repositories >= {WIDE_REPOSITORIES} THEN 'copied'
  WHEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= {DISTINCT} THEN 'live' ELSE 'weak' END AS verdict FROM each JOIN spread USING (v)),
kept AS (SELECT * FROM said WHERE base OR verdict = 'live')
SELECT doc_id, {counts}, sha256({listed.format(place, "FILTER (base)")}) AS base_sha256, {listed.format(place, some)} AS spans,
       {listed.format("verdict", some)} AS verdicts, {listed.format("owners::VARCHAR", some)} AS owners
FROM d LEFT JOIN kept USING (doc_id) GROUP BY doc_id
"""


ORACLE = _oracle()
