"""Text operators as queries. Sentences are built from table columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as sq
from ..functions import text
from ..operators import filters
from .base import TRAJECTORIES_SQL, joined, table, trajectories

Q: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list_sql(options) -> str:
    return "[" + ", ".join("'" + o.replace("'", "''") + "'" for o in options) + "]"


def _pick(options, place):
    return F.get(F.array(*map(F.lit, options)), (place % len(options)).cast("int"))


def _pick_sql(options, place: str) -> str:
    return f"list_extract({_list_sql(options)}, CAST({place} % {len(options)} AS INT) + 1)"


_REPLIES = (
    "Final Answer: ↑→↑STOP↑", "I would Move Forward, then turn left and stop", "forward forward LEFT right look up", "no actions here",
    "stray ↑ mark. Final Answer: ←←←←→", "Final Answer: turn right, Stop", "Final Answer: ↑ then left, STOP", "unstoppable rightful forwards",
)
_REPLY_SQL = f"replies AS (SELECT event_id, {_pick_sql(_REPLIES, 'event_id')} || CASE WHEN event_id % 3 = 0 THEN ' move forward' ELSE '' END AS reply FROM events)"
_NAME_SQL = "CASE lower(m) WHEN 'move forward' THEN 'move_forward' WHEN 'forward' THEN 'move_forward' WHEN 'turn left' THEN 'turn_left' WHEN 'left' THEN 'turn_left' WHEN 'turn right' THEN 'turn_right' WHEN 'right' THEN 'turn_right' WHEN 'move backward' THEN 'move_backward' WHEN 'backward' THEN 'move_backward' WHEN 'look up' THEN 'look_up' WHEN 'look down' THEN 'look_down' WHEN '↑' THEN 'move_forward' WHEN '←' THEN 'turn_left' WHEN '→' THEN 'turn_right' ELSE 'stop' END"
_TAIL_SQL = "string_split(reply, 'Final Answer:')[-1]"


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    tail = F.when(F.col("event_id") % 3 == 0, " move forward").otherwise("")
    return events.select("event_id", F.concat(_pick(_REPLIES, F.col("event_id")), tail).alias("reply"))


@query(
    f"""WITH {_REPLY_SQL}, marked AS (SELECT event_id, reply, {_TAIL_SQL} AS tail, regexp_extract_all({_TAIL_SQL}, '↑|←|→|STOP') AS marks FROM replies)
    SELECT event_id, array_to_string(CASE WHEN regexp_matches(tail, '[↑←→]|\\bSTOP\\b')
        THEN [{_NAME_SQL} FOR m IN (CASE WHEN list_position(marks, 'STOP') > 0 THEN marks[1:least(4, list_position(marks, 'STOP'))] ELSE marks[1:4] END)]
        ELSE [{_NAME_SQL} FOR m IN regexp_extract_all(reply, '(?i)\\b(move forward|turn left|turn right|move backward|look up|look down|forward|left|right|backward|stop)\\b')[1:4]] END, ',') AS actions
    FROM marked"""
)
def parse_actions_answer(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("event_id", F.array_join(text.parse_answer(F.col("reply")), ",").alias("actions"))


@query(
    f"""WITH {_REPLY_SQL} SELECT event_id, array_to_string([{_NAME_SQL} FOR m IN
        regexp_extract_all({_TAIL_SQL}, '(?i)stop|[↑←→]|\\b(?:move forward|turn left|turn right|forward|left|right)\\b')[1:6]], ',') AS actions FROM replies"""
)
def parse_actions_mixed(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("event_id", F.array_join(text.parse_mixed(F.col("reply")), ",").alias("actions"))


@query(
    f"""WITH {_REPLY_SQL} SELECT event_id, CASE WHEN len(regexp_extract_all(reply, '[↑←→]')) = 0 THEN 'stop'
        ELSE array_to_string([{_NAME_SQL} FOR m IN regexp_extract_all(reply, '[↑←→]')], ',') END AS actions FROM replies"""
)
def parse_actions_glyphs(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("event_id", F.array_join(text.parse_glyphs(F.col("reply")), ",").alias("actions"))


@query(f"WITH {TRAJECTORIES_SQL} SELECT user_id, array_to_string(actions, ',') AS ids FROM trajectories")
def glyph_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Action numbers through glyph text and back."""
    return trajectories(spark, sf).select("user_id", joined(text.glyphs_to_ids(text.ids_to_glyphs(F.col("actions")))).alias("ids"))


@query(
    f"""WITH {_REPLY_SQL}, parts AS (SELECT event_id, [trim(p) FOR p IN string_split(regexp_extract(reply, '(?s)Final Answer:(.*)$', 1), ',')] AS ps FROM replies)
    SELECT event_id, array_to_string([p FOR p IN ps IF p <> ''], '|') AS parts FROM parts"""
)
def final_answer_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _replies(spark, sf).select("event_id", F.array_join(text.final_answer_parts(F.col("reply")), "|").alias("parts"))


_STOP_SQL = _list_sql(text.STOP_WORDS)


@query(f"SELECT doc_id, array_to_string([lower(t) FOR t IN regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']+') IF NOT list_contains({_STOP_SQL}, lower(t))], ' ') AS tokens FROM documents")
def content_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.content_tokens(F.col("text")), " ").alias("tokens"))


@query(
    f"""WITH toks AS (SELECT doc_id, list_distinct([lower(t) FOR t IN regexp_extract_all(text, '[A-Za-z][A-Za-z\\-'']+') IF NOT list_contains({_STOP_SQL}, lower(t))]) AS a FROM documents)
    SELECT x.doc_id, CASE WHEN len(x.a) = 0 THEN 1.0 WHEN len(y.a) = 0 THEN 0.0 ELSE len(list_intersect(x.a, y.a)) / CAST(len(x.a) AS DOUBLE) END AS overlap
    FROM toks x JOIN toks y ON y.doc_id = x.doc_id + 1"""
)
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    following = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(following, "doc_id").select("doc_id", text.token_overlap(F.col("text"), F.col("next")).alias("overlap"))


@query(
    """SELECT doc_id, CASE WHEN strpos(text, lang) > 0 THEN substr(text, 1, strpos(text, lang) - 1) || '<' || source || '>' || substr(text, strpos(text, lang) + length(lang)) ELSE text END AS swapped
    FROM documents"""
)
def swap_first(spark: SparkSession, sf: str) -> DataFrame:
    new = F.concat(F.lit("<"), F.col("source"), F.lit(">"))
    return table(spark, sf, "documents").select("doc_id", text.swap_first(F.col("text"), F.col("lang"), new).alias("swapped"))


_TEMPLATES = ("A_starting_if", "B_if_then", "D_if_stay", "E_from_here")
_ROOMS = ("The Kitchen", "a hallway", None, "Living Room", " an office ")
_THINGS = ("snowmobile.", "two chairs", "Umbrellas", "the glass", None, "piano stool")
_CONDS = ("There is a lamp on the desk.", None, "lamps are lit", "the door is open", "Both doors are shut")


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    k = F.col("p_partkey")
    room = text.normalize_room(_pick(_ROOMS, k))
    condition = text.normalize_condition(_pick(_CONDS, k), F.array(F.col("p_name")), room)
    original = F.concat(F.lit("Walk to the "), F.col("p_name"), F.lit(" and stop there. "))
    return part.select(
        k.alias("p_partkey"), _pick(_TEMPLATES, F.floor(k / 7)).alias("template"), room.alias("room"), condition.alias("condition"), text.normalize_object(_pick(_THINGS, k)).alias("thing"), original.alias("original")
    )


def _null_list_sql(options) -> str:
    return "[" + ", ".join("NULL" if o is None else f"'{o}'" for o in options) + "]"


_COND_SQL = f"""facts AS (SELECT p_partkey, p_name, list_extract({_list_sql(_TEMPLATES)}, CAST(floor(p_partkey / 7) AS INT) % 4 + 1) AS template,
        coalesce(nullif(regexp_replace(lower(trim(list_extract({_null_list_sql(_ROOMS)}, CAST(p_partkey % 5 AS INT) + 1))), '^(the|a|an)\\s+', ''), ''), 'room') AS room,
        list_extract({_null_list_sql(_CONDS)}, CAST(p_partkey % 5 AS INT) + 1) AS phrase,
        list_extract(['a snowmobile', 'two chairs', 'umbrellas', 'a glass', 'a pool table', 'a piano stool'], CAST(p_partkey % 6 AS INT) + 1) AS thing FROM part),
    conditions AS (SELECT *, CASE WHEN regexp_matches(phrase, '(?i)^(there\\s+is|there\\s+are|both|the\\b)') THEN lower(phrase[1]) || rtrim(phrase[2:], '.')
            ELSE 'there is ' || p_name END AS condition, 'walk to the ' || p_name || ' and stop there' AS body FROM facts),
    said AS (SELECT p_partkey, template, CASE template
        WHEN 'A_starting_if' THEN 'Starting from the ' || room || ', if ' || condition || ', ' || body || '. Otherwise, stop in the ' || room || '.'
        WHEN 'B_if_then' THEN 'If ' || condition || ', ' || body || '; otherwise, return to your starting point.'
        WHEN 'D_if_stay' THEN 'If there is ' || thing || ' in the ' || room || ', stop where you are; otherwise, ' || body || '.'
        ELSE 'From where you are right now, if there is ' || thing || ', stop in the ' || room || '; otherwise, ' || body || '.' END AS instruction, room, condition, thing, body FROM conditions)"""


@query(f"WITH {_COND_SQL} SELECT p_partkey, instruction FROM said")
def conditional_templates(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    said = text.conditional(c("template"), c("room"), c("condition"), c("thing"), c("original"))
    return _conditions(spark, sf).select("p_partkey", said.alias("instruction"))


@query(
    f"""WITH {_COND_SQL} SELECT p_partkey, template, CASE WHEN template = 'B_if_then' THEN NULL ELSE room END AS room,
        CASE WHEN template IN ('A_starting_if', 'B_if_then') THEN condition END AS condition, CASE WHEN template IN ('D_if_stay', 'E_from_here') THEN thing END AS thing, body,
        CASE WHEN template IN ('A_starting_if', 'B_if_then') THEN 'Starting from the ' || CASE WHEN template = 'B_if_then' THEN 'room' ELSE room END || ', if ' || condition || ', stop where you are. Otherwise, ' || body || '.'
             ELSE 'If there is ' || thing || ' in the ' || room || ', ' || body || '; otherwise, stop where you are.' END AS sibling FROM said"""
)
def template_reparse(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    said = _conditions(spark, sf).select("p_partkey", text.conditional(c("template"), c("room"), c("condition"), c("thing"), c("original")).alias("said"))
    parsed = said.select("p_partkey", text.reparse_template(c("said")).alias("p"))
    return parsed.select("p_partkey", "p.*", text.sibling(c("p"), c("p.body")).alias("sibling"))


_STAIRS = (
    "Walk up the stairs and wait.", "Leave the room. Go down another flight of stairs, then stop", "take the staircase down to the hall", "the bedroom is upstairs",
    "Descend the steps! climb up the long wooden steps", "no floors here", "turn left and go upstairs",
)
_STAIR_RE2 = text.STAIR_PATTERN
_STYLES = ("absolute", "fuzzy", "updown")


@query(
    f"""WITH facts AS (SELECT s_suppkey AS k, {_pick_sql(_STAIRS, 's_suppkey')} AS said, {_pick_sql(_STYLES, 's_suppkey')} AS style,
        CASE WHEN s_nationkey % 2 = 0 THEN 'up' ELSE 'down' END AS direction, s_nationkey % 4 + 1 AS fin FROM supplier),
    phrased AS (SELECT *, CASE WHEN regexp_extract(said, '{_STAIR_RE2}', 0) <> '' THEN regexp_extract(said, '{_STAIR_RE2}', 0) ELSE regexp_extract(said, '{text.BARE_STAIR_PATTERN}', 0) END AS found,
        CASE style WHEN 'updown' THEN list_extract(['go', 'head'], k % 2 + 1) || ' ' || direction || 'stairs'
             ELSE list_extract(['go ' || direction || ' to', 'head ' || direction || ' to', 'go to'], k % 3 + 1) || ' ' ||
                CASE WHEN style = 'fuzzy' AND fin = 4 THEN list_extract(['the top floor', 'the topmost floor'], k % 2 + 1)
                     WHEN style = 'fuzzy' AND fin = 1 THEN list_extract(['the bottom floor', 'the ground floor', 'the lowest floor'], k % 3 + 1)
                     ELSE 'the ' || list_extract(['first', 'second', 'third', 'fourth'], fin) || ' floor' END END AS phrase FROM facts)
    SELECT k AS s_suppkey, CASE WHEN found = '' THEN said ELSE substr(said, 1, strpos(said, found) - 1) ||
        CASE WHEN strpos(said, found) = 1 OR substr(said, strpos(said, found) - 2, 2) IN ('. ', '? ', '! ') THEN upper(phrase[1]) || phrase[2:] ELSE phrase END
        || substr(said, strpos(said, found) + length(found)) END AS rewritten FROM phrased"""
)
def stair_substitute(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    direction = F.when(F.col("s_nationkey") % 2 == 0, "up").otherwise("down")
    phrase = text.floor_phrase(_pick(_STYLES, k), direction, F.col("s_nationkey") % 4 + 1, F.lit(4), k)
    return s.select("s_suppkey", text.substitute_stairs(_pick(_STAIRS, k), phrase).alias("rewritten"))


@query(
    """SELECT s_suppkey, CASE
        WHEN s_suppkey % 3 = 0 AND s_nationkey % 2 = 0 THEN 'Please head up to the ' || word || ' floor and stop.'
        WHEN s_suppkey % 3 = 1 THEN CASE WHEN s_nationkey % 2 = 0 THEN 'Go up ' ELSE 'Go down ' END || abs(fin - 2) || CASE WHEN abs(fin - 2) = 1 THEN ' floor' ELSE ' floors' END || ' and stop.'
        WHEN s_suppkey % 3 = 2 AND fin = 7 THEN 'Please go to the top floor and stop.'
        WHEN s_suppkey % 3 = 2 AND fin = 1 THEN 'Please go to the bottom floor of the house and stop.'
        ELSE 'Please go to the ' || word || ' floor and stop.' END AS said
    FROM (SELECT *, s_nationkey % 7 + 1 AS fin, CASE s_nationkey % 7 WHEN 0 THEN 'first' WHEN 1 THEN 'second' WHEN 2 THEN 'third' WHEN 3 THEN 'fourth' WHEN 4 THEN 'fifth' WHEN 5 THEN '6th' ELSE '7th' END AS word FROM supplier)"""
)
def vertical_rules(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    style = _pick(("absolute", "relative", "fuzzy"), k)
    said = text.vertical_rule(style, F.lit(2), n % 7 + 1, F.lit(7), F.when(n % 2 == 0, "up").otherwise("down"))
    return table(spark, sf, "supplier").select("s_suppkey", said.alias("said"))


@query(
    """WITH facts AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
    SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey % 2 = 0 OR q = 180 AS ok, q + l_linenumber * 0.25::DOUBLE + 180 AS total FROM facts"""
)
def number_multiset(spark: SparkSession, sf: str) -> DataFrame:
    """Do an instruction's numbers match its segments? Odd suppliers' segments lack the half circle that their text has."""
    return _numbers_matched(table(spark, sf, "lineitem"), F.col("l_suppkey") % 2 == 0)


def _numbers_matched(rows: DataFrame, whole: Column) -> DataFrame:
    q, m = F.col("l_quantity").cast("long"), F.col("l_linenumber") * F.lit(0.25)
    said = F.concat(F.lit("Go "), text.format_meters(m), F.lit(" meters, turn "), q.cast("string"), F.lit(" degrees and make half a circle."))
    expected = F.when(whole, F.array(F.lit(180.0), q.cast("double"), m)).otherwise(F.array(q.cast("double"), m, q.cast("double")))
    found = text.numbers_in(said)
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", text.numbers_match(found, expected).alias("ok"), F.aggregate(found, F.lit(0.0), lambda s, x: s + x).alias("total"))


_CHAT_SQL = "chats AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn) AS ms FROM conversations GROUP BY conv_id)"


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    one = F.struct("turn", "role", "text")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("messages"))


@query(
    f"""WITH {_CHAT_SQL}, t AS (SELECT conv_id, ms, range(1, len(ms) + 1) AS r FROM chats) SELECT conv_id,
        md5('S###' || array_to_string([m.role || ': ' || m.text || '###' FOR m IN ms], '')) AS single,
        md5('S#' || array_to_string([ms[i].role || ': ' || ms[i].text || CASE WHEN i % 2 = 1 THEN '#' ELSE '</s>' END FOR i IN r], '')) AS two,
        md5('S<end>' || chr(10) || array_to_string([m.role || chr(10) || m.text || '<end>' || chr(10) FOR m IN ms], '')) AS chatml,
        md5('S<end>' || array_to_string([m.role || m.text || '<end>' FOR m IN ms], '')) AS mpt,
        md5(array_to_string([m.role || m.text || '<end>' FOR m IN ms], '')) AS gemma,
        md5(array_to_string([CASE WHEN i % 2 = 1 THEN CASE WHEN i = 1 THEN '' ELSE '<s>' END || '[INST] ' || CASE WHEN i = 1 THEN '<<SYS>>' || chr(10) || 'S' || chr(10) || '<</SYS>>' || chr(10) || chr(10) ELSE '' END || ms[i].text || ' [/INST]' ELSE ' ' || ms[i].text || ' </s>' END FOR i IN r], '')) AS llama_2,
        md5('S' || array_to_string([ms[i].text || CASE WHEN i % 2 = 1 THEN '#' ELSE '</s>' END FOR i IN r], '')) AS plain FROM t"""
)
def conversation_linearise(spark: SparkSession, sf: str) -> DataFrame:
    m = F.col("messages")
    digest = lambda *a: F.md5(text.linearize(m, *a).cast("binary"))
    return _chats(spark, sf).select(
        "conv_id", digest("SINGLE", "S", "###").alias("single"), digest("TWO", "S", "#").alias("two"), digest("CHATML", "S", "<end>").alias("chatml"), digest("MPT", "S", "<end>").alias("mpt"),
        digest("GEMMA", "S", "<end>").alias("gemma"), digest("LLAMA_2", "S", "<s>").alias("llama_2"), digest("PLAIN", "S", "#").alias("plain"),
    )


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation sample per event: every answer lists five to seven actions."""
    k = F.col("event_id")
    n = (5 + k % 3).cast("int")
    parts = F.transform(sq.indices(n), lambda i: F.when((k % 4 == 3) & (i == 2), "Turn Left").otherwise(F.when(k % 5 == 4, "Turn Right").otherwise("Stop")))
    answer = F.concat(F.lit("Final Answer: "), F.array_join(parts, ", "))
    return table(spark, sf, "events").select("event_id", sq.two_turns(F.lit("go"), answer).alias("conversations"))


_SAMPLE_SQL = """samples AS (SELECT event_id, 'Final Answer: ' || array_to_string([CASE WHEN event_id % 4 = 3 AND i = 2 THEN 'Turn Left' WHEN event_id % 5 = 4 THEN 'Turn Right' ELSE 'Stop' END
    FOR i IN range(0, 5 + event_id % 3)], ', ') AS answer FROM events)"""


@query(f"WITH {_SAMPLE_SQL} SELECT event_id FROM samples WHERE contains(answer, 'Stop')")
def stop_only(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).where(filters.mentions_stop(F.col("conversations"))).select("event_id")


@query(f"WITH {_SAMPLE_SQL} SELECT event_id FROM samples WHERE contains(answer, 'Stop, Stop, Stop, Stop, Stop, Stop') AND NOT contains(answer, 'Turn')")
def all_stop(spark: SparkSession, sf: str) -> DataFrame:
    return _samples(spark, sf).where(filters.all_stop(filters.answer_of(F.col("conversations")))).select("event_id")


@query(
    """SELECT conv_id, (CASE WHEN conv_id % 2 = 0 THEN words + 128 ELSE -words END)::BIGINT AS length FROM (SELECT conv_id,
        sum(len([w FOR w IN string_split_regex(text, '\\s+') IF w <> ''])) AS words FROM conversations GROUP BY conv_id)"""
)
def word_lengths(spark: SparkSession, sf: str) -> DataFrame:
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["text"].alias("value")))
    return _chats(spark, sf).select("conv_id", sq.modality_length(turns, F.col("conv_id") % 2 == 0).cast("long").alias("length"))


@query(
    r"""SELECT page_id, lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS name,
        CASE WHEN page_id % 3 = 0 THEN 'unknown' ELSE regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') END AS component FROM pages"""
)
def sanitize(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.sanitize_name(url).alias("name"), text.sanitize_component(F.when(F.col("page_id") % 3 > 0, url)).alias("component"))


@query("SELECT page_id, split_part(url, '/', -1) AS last, split_part(url, '/', -2) AS parent, CASE WHEN starts_with(url, 'http://') THEN substr(url, 8) ELSE url END AS bare FROM pages")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.last_part(url).alias("last"), text.parent_part(url).alias("parent"), text.strip_prefix(url, "http://").alias("bare"))


@query(
    """WITH tags AS (SELECT c_custkey, printf('%s_%s_%06d', lower(c_mktsegment), 'aug', c_custkey * 997) || CASE WHEN c_nationkey % 3 > 0 THEN '_v' || c_nationkey % 3 ELSE '' END AS tag FROM customer)
    SELECT c_custkey, tag, try_cast(regexp_extract(tag || '_step_' || c_custkey, '_([0-9]+)_step_([0-9]+)$', 1) AS BIGINT) AS episode,
        coalesce(try_cast(nullif(regexp_extract('traj_' || CASE WHEN c_custkey % 2 = 0 THEN c_custkey::VARCHAR ELSE 'x' END || '_a', 'traj_([0-9]+)_', 1), '') AS BIGINT), 1000000000) AS idx FROM tags"""
)
def ep_tags(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    tag = text.ep_tag(F.lower("c_mktsegment"), F.lit("aug"), k * 997, F.col("c_nationkey") % 3)
    name = F.concat(F.lit("traj_"), F.when(k % 2 == 0, k.cast("string")).otherwise("x"), F.lit("_a"))
    return table(spark, sf, "customer").select(
        "c_custkey", tag.alias("tag"), text.parse_step_id(F.concat(tag, F.lit("_step_"), k.cast("string")))["episode"].alias("episode"), text.number_in_name(name).alias("idx")
    )
