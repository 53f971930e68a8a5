"""Personal data: regular expressions propose spans, validators confirm them, context words adjust the score.

DataFrame functions only, one row in and one row out, no shuffle. A span's place follows from the text between matches:
``split`` gives the pieces and ``regexp_extract_all`` the matches, both by one left-to-right scan, and a fold adds
their lengths, block by block, so that a text of many thousand matches takes linear time. The patterns are possessive and start only where the scan ended before (``\\G``) or after a character
outside the leading class. That changes no match - an earlier start in the same run would have matched - but makes the
scan linear even on megabytes of unbroken digits or letters, and keeps Java's matcher off its stack.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.arrays import blocks, bound, running
from weftline.llm.shared import documents, text_or_empty

#: Characters before a span that are searched for context words.
CONTEXT_CHARS = 40
#: Score, in hundredths, that a span outside the base kinds needs.
EXTRA_THRESHOLD = 60


@dataclass(frozen=True)
class Kind:
    """One kind of personal data; ``base`` spans are returned whatever their score."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    score: int
    words: str
    hint: Callable[[Column], Column]
    base: bool = True
    context: int = 10


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether an international account number (capitals and digits, no spaces) leaves 1 modulo 97."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _card(m: Column) -> Column:
    d = _digits(m)
    return F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))


def _account(m: Column) -> Column:
    a = F.replace(m, F.lit(" "), F.lit(""))
    return F.when(a.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), mod97(a)).otherwise(F.lit(False))


#: In the order in which equal starts are listed.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), 85,
         "mail|contact|kontakt|correo|courriel", lambda t: F.contains(t, F.lit("@"))),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", lambda m: F.forall(F.split(m, r"\."), lambda p: p.rlike(r"^0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$")), 60,
         "ip|host|server|address|adresse|login", lambda t: F.contains(t, F.lit("."))),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, 75, "card|visa|master|credit|karte|carte|tarjeta", lambda t: t.rlike("[0-9]")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), 70,
         "phone|call|tel|fax|mobil|handy|llam", lambda t: F.contains(t, F.lit("+"))),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,}+|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", _account, 85,
         "iban|account|bank|konto|compte|cuenta", lambda t: t.rlike("[A-Z]{2}[0-9]{2}"), base=False),
    Kind("ssn", r"(?:\G|(?<![0-9]))[0-9]++-[0-9]++-[0-9]++", lambda m: m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$") & ~m.rlike("^(?:000|666|9)|-00-|-0000$"), 40,
         "ssn|social security", lambda t: F.contains(t, F.lit("-")), base=False, context=30),
)

_EMPTY = "CAST(array() AS array<struct<start:int,rank:int,end:int,kind:string,score:int>>)"


_FOUND = "CAST(array() AS array<struct<start:int,end:int,found:string,near:string>>)"


def _placed(text: Column, parts: Column) -> Column:
    """(start, end, found, near) of all matches; ``parts`` has (piece, match) in blocks, each folded from where it starts."""
    lengths = F.transform(parts, lambda part: F.aggregate(part, F.lit(0), lambda n, p: n + F.length(p["piece"]) + F.coalesce(F.length(p["match"]), F.lit(0))))

    def step(acc: Column, pair: Column) -> Column:
        begin, before = acc["at"] + F.length(pair["piece"]), F.right(F.concat(acc["tail"], pair["piece"]), F.lit(CONTEXT_CHARS))
        end = begin + F.length(pair["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), pair["match"].alias("found"), before.alias("near"))
        tail = F.right(F.concat(before, pair["match"]), F.lit(CONTEXT_CHARS))
        return F.when(pair["match"].isNull(), acc).otherwise(F.struct(end.alias("at"), tail.alias("tail"), F.array_append(acc["found"], span).alias("found")))

    def folded(part: Column, at: Column) -> Column:
        tail = F.substring(text, F.greatest(at - CONTEXT_CHARS, F.lit(0)) + 1, F.least(at, F.lit(CONTEXT_CHARS)))
        return F.aggregate(part, F.struct(at.alias("at"), tail.alias("tail"), F.expr(_FOUND).alias("found")), step)["found"]

    return F.flatten(F.zip_with(parts, running(lengths, lambda a, x: a + x), folded))


def spans_of(text: Column, rank: int, kind: Kind) -> Column:
    """The confirmed spans of one kind: array of (start, rank, end, kind, score), in code points, end exclusive."""
    pairs = F.zip_with(
        F.split(text, kind.pattern, -1),
        F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)),
        lambda piece, match: F.struct(piece.alias("piece"), match.alias("match")),
    )
    placed = bound(pairs, lambda p: bound(blocks(p), lambda parts: _placed(text, parts)))
    found = F.filter(placed, lambda s: kind.valid(s["found"]))

    def scored(s: Column) -> Column:
        score = F.when(F.lower(s["near"]).rlike(kind.words), kind.score + kind.context).otherwise(F.lit(kind.score))
        return F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), score.alias("score"))

    spans = F.transform(found, scored)
    if not kind.base:
        spans = F.filter(spans, lambda s: s["score"] >= EXTRA_THRESHOLD)
    return F.when(kind.hint(text), spans).otherwise(F.expr(_EMPTY))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """One row per input row: doc_id and, for each kind, its spans as an array of (start, rank, end, kind, score).

    Null texts have no spans, ids may be null or repeat, other columns are not read, an empty table gives no rows.
    """
    text = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("__text"))
    return text.select("doc_id", *(spans_of(F.col("__text"), i, k).alias(f"{k.name}_spans") for i, k in enumerate(kinds)))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span of the array replaced by its kind in angle brackets; of overlapping spans the first stays."""

    def step(acc: Column, s: Column) -> Column:
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), kept.alias("out")))

    whole = F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(whole["out"], F.substring(text, whole["at"] + 1, F.length(text)))


def query(spark, sf_dir):
    """op8: every whole text of ``documents``."""
    found = find_pii(documents(spark, sf_dir))
    base = F.concat(*(F.col(f"{k.name}_spans") for k in KINDS if k.base))
    every = F.concat(*(F.col(f"{k.name}_spans") for k in KINDS))
    return found.select(
        "doc_id",
        *(F.size(f"{k.name}_spans").cast("long").alias(f"n_{k.name}") for k in KINDS if k.base),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(every).alias("spans"),
        F.array_join(F.transform(F.array_sort(every), lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def _oracle() -> str:
    """The same by DuckDB, whose matcher is linear and needs no possessive forms."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Za-z0-9]{11,}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
        "ssn": r"[0-9]+-[0-9]+-[0-9]+",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    account = "replace(m, ' ', '')"
    doubled = "CASE WHEN i % 2 = 1 THEN CASE WHEN d > 4 THEN d * 2 - 9 ELSE d * 2 END ELSE d END"
    luhn_sum = f"list_sum(list_transform(range(length({digits})), lambda i: list_transform([({digits})[length({digits}) - i]::INT], lambda d: {doubled})[1]))"
    turned = f"string_split(substr({account}, 5) || substr({account}, 1, 4), '')"
    rest = f"list_reduce(list_prepend(0::INT, list_transform({turned}, lambda c: ascii(c)::INT)), lambda r, c: CASE WHEN c >= 65 THEN (r * 100 + c - 55) % 97 ELSE (r * 10 + c - 48) % 97 END)"
    valid = {
        "email": "true",
        "ip": r"regexp_full_match(m, '(0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])\.){3}0*([0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])')",
        "card": f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN {luhn_sum} % 10 = 0 ELSE false END",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": f"CASE WHEN regexp_full_match({account}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') THEN {rest} = 1 ELSE false END",
        "ssn": "regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|-0000$')",
    }
    parts = []
    for rank, k in enumerate(KINDS):
        parts.append(f"""
SELECT doc_id, {rank} AS rank, '{k.name}' AS kind, {str(k.base).lower()} AS base, e - length(m) AS s, e,
       CASE WHEN regexp_matches(lower(substr(t, greatest(e - length(m) - {CONTEXT_CHARS}, 0) + 1, least(e - length(m), {CONTEXT_CHARS}))), '{k.words}')
            THEN {k.score + k.context} ELSE {k.score} END AS score
FROM (
  SELECT doc_id, t, ms[i] AS m, (list_sum(list_transform(ps[1:i], lambda x: length(x))) + list_sum(list_transform(ms[1:i], lambda x: length(x))))::BIGINT AS e
  FROM (SELECT doc_id, t, ps, ms, unnest(range(1, len(ms) + 1)) AS i
        FROM (SELECT doc_id, t, string_split_regex(t, '{plain[k.name]}') AS ps, regexp_extract_all(t, '{plain[k.name]}') AS ms FROM d))
) WHERE {valid[k.name]}""")
    listed = "coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) {}, '')"
    counts = ", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in KINDS if k.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)}),
kept AS (SELECT * FROM spans WHERE base OR score >= {EXTRA_THRESHOLD})
SELECT doc_id, {counts}, sha256({listed.format("FILTER (base)")}) AS base_sha256, {listed.format("FILTER (kind IS NOT NULL)")} AS spans,
       coalesce(string_agg(score::VARCHAR, ',' ORDER BY s, rank) FILTER (kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN kept USING (doc_id) GROUP BY doc_id
"""


ORACLE = _oracle()
