"""Queries over proposed edits, made of the tables' rows so that SQL knows their verdicts: figures, guard, location, streams, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.operators import edits
from inkwell.sources.tables import spread, table
from inkwell.streaming import chunks, counts

#: The kinds of edits that `proposed` makes of a customer, and what becomes of each.
KINDS = ("unchanged", "numbers_changed", None, "units_changed", "negation_changed", "markup", "too_long", "figures_swapped", "span_too_long", None)


def proposed(spark: SparkSession, d: str) -> DataFrame:
    """(id, kind, original, replacement): an edit for each customer, of a kind by its key, with the customer's own figures."""
    n, m = F.col("c_custkey").cast("string"), (F.col("c_custkey") + 70_001).cast("string")
    plain = F.concat(F.lit("In total "), n, F.lit(" seats cost $"), m, F.lit(" there, not less."))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    made = (
        (plain, say("in total  ", n, " seats cost $", m, " there, NOT less.")),
        (plain, say("In total ", m, " seats cost $", m, " there, not less.")),
        (plain, say("There, ", n, " seats cost ", m, " dollars, not less.")),
        (plain, say("In total ", n, " seats cost ", m, " euros there, not less.")),
        (say("The ", n, " seats are sold."), say("The ", n, " seats are not sold.")),
        (plain, say("<b>In total</b> ", n, " seats cost $", m, " there, not less.")),
        (plain, say(plain, F.repeat(F.lit(" and so on"), 30))),
        (say("Oslo sold ", n, " and Lima ", m, "."), say("Oslo sold ", m, " and Lima ", n, ".")),
        (F.concat(plain, F.repeat(F.lit(" x"), 300)), plain),
        (say("Oslo sold ", n, " and Lima ", m, "."), say("Lima sold ", m, " and Oslo ", n, ".")),
    )
    kind = F.pmod("c_custkey", F.lit(len(made)))
    pair = F.element_at(F.array(*[F.struct(a.alias("original"), b.alias("replacement")) for a, b in made]), (kind + 1).cast("int"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), kind.alias("kind"), pair.alias("p")).select("id", "kind", "p.*")


def guard_basic(spark: SparkSession, d: str) -> DataFrame:
    return proposed(spark, d).select("id", edits.cheap_reason(F.col("original"), F.col("replacement")).alias("reason"))


def guard_full(spark: SparkSession, d: str) -> DataFrame:
    return edits.reasons(proposed(spark, d)).select("id", "reason")


def _bills(spark: SparkSession, d: str) -> DataFrame:
    """Orders as sentences whose figures are known: spelled with spaces, points, marks and dates."""
    whole = F.floor("o_totalprice").cast("bigint")
    price = F.concat_ws("", F.regexp_replace(F.format_number(whole, 0), ",", "\u00a0"), F.lit(",5"))
    text = F.concat(F.lit("Le "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(": "), price, F.lit(" € payés, "), F.pmod("o_orderkey", F.lit(90)) + 10, F.lit(" pour cent de "), F.col("o_custkey") + 2500, F.lit(" million de dollars par mois"))
    return spread(table(spark, d, "orders")).select("o_orderkey", text.alias("text"))


def figures_extract(spark: SparkSession, d: str) -> DataFrame:
    found = _bills(spark, d).select("o_orderkey", F.posexplode(edits.figures_of(F.col("text"))).alias("n", "f"))
    return found.select("o_orderkey", F.col("n").cast("bigint"), "f.value", "f.start")


def figure_readings(spark: SparkSession, d: str) -> DataFrame:
    found = _bills(spark, d).select("o_orderkey", F.posexplode(edits.readings_of(F.col("text"))).alias("n", "r"))
    return found.select("o_orderkey", F.col("n").cast("bigint"), "r.scale", "r.units")


def names_found(spark: SparkSession, d: str) -> DataFrame:
    """Names in a sentence about each customer: runs of capitalised words, without openers and units beside figures."""
    text = F.concat(F.lit("The Segment "), F.initcap("c_mktsegment"), F.lit(" has 5 GB of Client "), F.col("c_custkey"), F.lit(". However, Paris Nord sold 3 Md to "), "c_mktsegment")
    return table(spark, d, "customer").select("c_custkey", F.array_join(edits.names_of(text), "|").alias("names"))


def stand_in_edits(spark: SparkSession, d: str) -> DataFrame:
    made = edits.stand_in(table(spark, d, "documents"))
    return made.select("attempt_id", "seq", F.md5(F.col("original").cast("binary")).alias("original_md5"), "replacement")


#: A text for each customer, and the edits that are proposed of it in order, with what becomes of them.
_LETTER = ("Customer ", " lives here. The balance was paid in full, for once. Paid in full, wrote the clerk of ", ". It is a very, very long story.")
_EDITS = (
    ("lives here", "stays here", None),
    ("paid in full", "settled", None),
    ("The balance", "The balance of 5", "numbers_changed"),
    ("absent words", "present words", "not_found"),
    ("a very, very long", "a long", None),
    ("lives here", "is here", "not_found"),
    ("Paid in full", "Settled", None),
)


def _attempts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The edits of every customer's text, as a model would send them, and the texts, each once."""
    letter = F.concat(F.lit(_LETTER[0]), "c_custkey", F.lit(_LETTER[1]), "c_mktsegment", F.lit(_LETTER[2]))
    texts = table(spark, d, "customer").select(F.col("c_custkey").alias("attempt_id"), letter.alias("text"))
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("seq"), F.lit(a).alias("original"), F.lit(b).alias("replacement")) for k, (a, b, _) in enumerate(_EDITS)])
    return texts.select("attempt_id", F.explode(rows).alias("e")).select("attempt_id", "e.*"), texts


def locate_edits(spark: SparkSession, d: str) -> DataFrame:
    return edits.collected(*_attempts(spark, d)).select("attempt_id", "seq", "id", "reason", "start", "end")


def drop_histogram(spark: SparkSession, d: str) -> DataFrame:
    return edits.histogram(edits.collected(*_attempts(spark, d)))


def apply_edits(spark: SparkSession, d: str) -> DataFrame:
    """All located edits accepted: the texts that come out."""
    made, texts = _attempts(spark, d)
    kept = edits.collected(made, texts).where("id is not null").withColumn("accepted", F.lit(True))
    return edits.applied(texts, kept).select("attempt_id", "result")


def review_progress(spark: SparkSession, d: str) -> DataFrame:
    return edits.progress(edits.collected(*_attempts(spark, d))).select("attempt_id", "seq", "dropped", F.round("share", 6).alias("share"))


def focus_moves(spark: SparkSession, d: str) -> DataFrame:
    """The focus two edits back, round the beginning."""
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("attempt_id"), F.concat(F.lit("edit-"), "turn").alias("id"), F.col("turn").cast("int").alias("start"))
    return edits.moved(rows, -2)


def all_decided(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("attempt_id"), F.lit("pending").alias("state"))
    return edits.decided(rows, "accepted")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """A model's answer for each turn, as JSON: an edit of the turn's text, an object that is no edit, and an edit with marks and braces."""
    edit = lambda **f: F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in f.items()]))
    made = F.concat_ws(",", edit(original=F.col("text"), replacement=F.col("role"), reason="r"), F.lit('{"original":"only"}'), edit(original='a {x} "q"', replacement="\\ ]}", reason=""))
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("attempt_id"), F.concat(F.lit('{"edits":['), made, F.lit("]}")).alias("text"))


def edit_stream_parse(spark: SparkSession, d: str) -> DataFrame:
    """Answers cut into pieces of 7 characters."""
    found = chunks.parsed(chunks.cut(_answers(spark, d), 7))
    return found.select("attempt_id", "n", F.md5(F.col("original").cast("binary")).alias("original_md5"), "replacement", "reason")


def outcome_table(spark: SparkSession, d: str) -> DataFrame:
    """How attempts end, whose marks are the bits of an event's id."""
    bit = lambda k: F.col("event_id").bitwiseAND(F.lit(1 << k)) > 0
    flags = table(spark, d, "events").select("event_id", bit(0).alias("complete"), bit(1).alias("refused"), F.when(bit(2), 2).otherwise(0).alias("delivered"), bit(3).alias("reader_left"))
    return chunks.outcome(flags).select("event_id", "event", "state", "saved")


def stream_user_counts(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts by a stream run to its end; complete mode, so that the last days are there without a later watermark."""
    import uuid

    stream = counts.event_stream(spark, d, "events.parquet")
    return counts.drained(counts.daily_counts(stream), f"counts_{uuid.uuid4().hex}", "complete")


def review_next(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("attempt_id"), F.concat(F.lit("edit-"), "turn").alias("id"), F.col("turn").cast("int").alias("start"), F.when(F.length("text") % 2 == 0, "pending").otherwise("accepted").alias("state"))
    return edits.next_pending(rows)


def reopened(spark: SparkSession, d: str) -> DataFrame:
    """Stored edits of every turn: the first word of its text, and for every third turn one that names something else, or lies outside."""
    first = F.regexp_extract("text", r"^[^ ]*", 0)
    edit = lambda a, b, o: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), o.alias("original"))
    good = edit(F.lit(0), F.length(first), first)
    wrong = F.when(F.col("turn") % 3 == 1, edit(F.lit(0), F.length(first), F.concat(first, F.lit("!")))).when(F.col("turn") % 3 == 2, edit(F.length("text"), F.length("text") + 1, F.lit("x")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", "text", F.array_compact(F.array(good, wrong)).alias("edits"))
    return rows.select("conv_id", "turn", edits.reopenable(rows).alias("valid"))


QUERIES = {f.__name__: f for f in (
    guard_basic, guard_full, figures_extract, figure_readings, names_found, stand_in_edits, locate_edits, drop_histogram, apply_edits, edit_stream_parse, outcome_table, stream_user_counts, review_next, reopened,
    review_progress, focus_moves, all_decided,
)}


def _verdicts(only: tuple[str, ...] | None = None) -> str:
    shown = ", ".join("NULL" if r is None or (only and r not in only) else f"'{r}'" for r in KINDS)
    return f"SELECT c_custkey AS id, ([{shown}])[(c_custkey % {len(KINDS)} + 1)::int]::varchar AS reason FROM customer"


_LETTER_SQL = f"'{_LETTER[0]}' || c_custkey || '{_LETTER[1]}' || c_mktsegment || '{_LETTER[2]}'"
_BILL = r"""
SELECT *, 'Le ' || day || ': ' || price AS head, ' € payés, ' AS paid FROM (
  SELECT o_orderkey, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS day, floor(o_totalprice)::bigint AS whole,
    regexp_replace(format('{:,}', floor(o_totalprice)::bigint), ',', chr(160), 'g') || ',5' AS price FROM orders)"""


def _outcomes() -> str:
    """DuckDB: each edit's verdict, its number among those kept, and its place by the first occurrence of its quote."""
    rows, kept = [], 0
    for k, (original, replacement, reason) in enumerate(_EDITS):
        rows.append(f"({k}::bigint, '{original}', '{replacement}', {'NULL' if reason else repr(f'edit-{kept}')}, {repr(reason) if reason else 'NULL'})")
        kept += reason is None
    return f"""SELECT c_custkey AS attempt_id, seq, id, reason, CASE WHEN id IS NULL THEN -1 ELSE strpos(letter, original) - 1 END AS start,
  CASE WHEN id IS NULL THEN -1 ELSE strpos(letter, original) - 1 + length(original) END AS "end", original, replacement
  FROM (SELECT c_custkey, {_LETTER_SQL} AS letter FROM customer), (VALUES {', '.join(rows)}) e(seq, original, replacement, id, reason)"""


def _result() -> str:
    out = _LETTER_SQL
    for original, replacement, reason in _EDITS:
        out = out if reason else f"replace({out}, '{original}', '{replacement}')"
    return f"SELECT c_custkey AS attempt_id, {out} AS result FROM customer"


_SPLIT = r"string_split(regexp_replace(text, '([.!?])[\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', '\1' || chr(1), 'g'), chr(1))"
ORACLES = {
    "guard_basic": _verdicts(("unchanged", "span_too_long", "too_long", "markup")),
    "guard_full": _verdicts(),
    "stand_in_edits": f"""
SELECT attempt_id, seq, md5(original) AS original_md5, replacement FROM (
  SELECT doc_id AS attempt_id, ((n - 1) / 2)::bigint AS seq, original, CASE WHEN substr(tail, 1, 1) = 'ß' THEN 'SS' ELSE upper(substr(tail, 1, 1)) END || substr(tail, 2) AS replacement FROM (
    SELECT *, array_to_string(list_slice(string_split(original, ' '), greatest(len(string_split(original, ' ')) - 5, 1), len(string_split(original, ' '))), ' ') AS tail FROM (
      SELECT doc_id, unnest(s) AS original, generate_subscripts(s, 1) AS n FROM (SELECT doc_id, list_filter({_SPLIT}, lambda x: x <> '') AS s FROM documents)) WHERE n % 2 = 1))
WHERE original <> replacement""",
    "figures_extract": f"""SELECT o_orderkey, n, value, start::int AS start FROM (SELECT o_orderkey, unnest([
    {{'n': 0::bigint, 'value': regexp_replace(day, '-0', '-0'), 'start': 3}}, {{'n': 1, 'value': whole || '.5', 'start': 15}},
    {{'n': 2, 'value': (o_orderkey % 90 + 10) || '%', 'start': 3 + 10 + 2 + length(price) + length(paid)}},
    {{'n': 3, 'value': (o_custkey + 2500)::varchar, 'start': 3 + 10 + 2 + length(price) + length(paid) + 2 + length(' pour cent de ')}}], recursive := true) FROM ({_BILL}))""",
    "figure_readings": """SELECT o_orderkey, n, scale, units FROM orders, (VALUES (0::bigint, '', ''), (1, '', 'euro'), (2, '', ''), (3, 'million', 'dollar,/month')) r(n, scale, units)""",
    "names_found": "SELECT c_custkey, 'Segment ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || '|Client|Paris Nord|' || c_mktsegment AS names FROM customer",
    "locate_edits": f'SELECT attempt_id, seq, id, reason, start::int AS start, "end"::int AS "end" FROM ({_outcomes()})',
    "drop_histogram": f"SELECT reason, count(*) AS n FROM ({_outcomes()}) WHERE reason IS NOT NULL GROUP BY 1",
    "apply_edits": _result(),
    "review_progress": f"SELECT attempt_id, seq, count(reason) OVER w AS dropped, round(count(id) OVER w / count(*) OVER w, 6) AS share FROM ({_outcomes()}) WINDOW w AS (PARTITION BY attempt_id ORDER BY seq)",
    "focus_moves": "SELECT a.conv_id AS attempt_id, 'edit-' || a.turn AS id, 'edit-' || b.turn AS moved_id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) a JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) b ON a.conv_id = b.conv_id AND b.k = ((a.k - 2) % a.n + a.n) % a.n",
    "all_decided": "SELECT conv_id AS attempt_id, count(*) AS n, count(*) AS accepted FROM conversations GROUP BY 1",
    "edit_stream_parse": """SELECT conv_id * 1000 + turn AS attempt_id, n, CASE WHEN n = 0 THEN md5(text) ELSE md5('a {x} "q"') END AS original_md5, CASE WHEN n = 0 THEN role ELSE chr(92) || ' ]}' END AS replacement, CASE WHEN n = 0 THEN 'r' ELSE '' END AS reason FROM conversations, (VALUES (0::bigint), (1)) e(n)""",
    "outcome_table": """SELECT event_id, CASE WHEN reader_left THEN 'none' WHEN complete AND NOT refused THEN 'done' WHEN NOT complete AND NOT refused AND delivered > 0 THEN 'done partial' ELSE 'error' END AS event,
  CASE WHEN reader_left THEN 'cancelled' WHEN complete AND NOT refused THEN 'succeeded' ELSE 'failed' END AS state,
  CASE WHEN reader_left THEN delivered > 0 ELSE NOT refused AND (complete OR delivered > 0) END AS saved
  FROM (SELECT event_id, event_id & 1 > 0 AS complete, event_id & 2 > 0 AS refused, CASE WHEN event_id & 4 > 0 THEN 2 ELSE 0 END AS delivered, event_id & 8 > 0 AS reader_left FROM events)""",
    "stream_user_counts": "SELECT ts::date AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "review_next": """
SELECT attempt_id, id, coalesce('edit-' || min(CASE WHEN open THEN start END) OVER (PARTITION BY attempt_id ORDER BY start RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
  'edit-' || min(CASE WHEN open THEN start END) OVER (PARTITION BY attempt_id), id) AS next_id
FROM (SELECT conv_id AS attempt_id, 'edit-' || turn AS id, turn AS start, length(text) % 2 = 0 AS open FROM conversations)""",
    "reopened": "SELECT conv_id, turn, turn % 3 = 0 AS valid FROM conversations",
}
