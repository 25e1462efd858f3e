"""Queries: scalar text, date, number and JSON functions, set algebra, rules, and keyed state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import table as t
from ..streaming import dialogue
from .registry import query

# ---- strings -------------------------------------------------------------------

LINES = r"""list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h1|h2|h3|h4|h5|h6)>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), chr(10)), lambda x: trim(regexp_replace(x, '[\s\x{00a0}]+', ' ', 'g'))), lambda x: x <> '')"""


@query("str01_clean", r"select page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\s\x{00a0}]+', ' ', 'g'))) as h from pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(tx.clean_markup(F.col("html"))).alias("h"))


@query("str02_html_to_text", f"select page_id, md5(array_to_string({LINES}, chr(10))) as h from pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.md5(F.array_join(tx.html_lines(F.col("html")), "\n")).alias("h"))


@query("str03_html_to_lines", f"select page_id, len({LINES})::bigint as n, ({LINES})[1] as first_line from pages")
def _(spark, sf):
    lines = tx.html_lines(F.col("html"))
    return t(spark, sf, "pages").select("page_id", F.size(lines).cast("long").alias("n"), F.get(lines, F.lit(0)).alias("first_line"))


#: A notice around each document: a menu, the start, the lines, the date behind its mark, counters, and what follows the end.
NOTICE = "list_concat(['menu', 'login'], ['Notice: ' || coalesce(source, '')], string_split(text, chr(10)), ['등록일', '2024. ' || (doc_id % 12 + 1) || '. 7.', '조회수 12', 'Next: other'], ['tail'])"


@query(
    "str04_extract_body",
    f"""with n as (select doc_id, {NOTICE} as ls from documents where text is not null),
p as (select *, list_position(list_transform(ls, lambda l: contains(l, 'Notice')), true) as s from n),
b as (select *, ls[s:s + 399] as body from p),
e as (select *, list_position(list_transform(body, lambda l, i: i > 1 and contains(l, 'Next:')), true) as z from b)
select doc_id, md5(array_to_string(list_filter(case when z > 0 then body[:z - 1] else body end, lambda l: length(l) > 3 and not contains(l, '조회수')), chr(10))) as body,
  case when z > 0 then '2024-' || lpad((doc_id % 12 + 1)::varchar, 2, '0') || '-07' else '' end as published from e""",
)
def _(spark, sf):
    """The body of a notice between its marks, without counters, and its date."""
    docs = t(spark, sf, "documents").where("text is not null")
    date = F.concat(F.lit("2024. "), (F.col("doc_id") % 12 + 1).cast("string"), F.lit(". 7."))
    lines = F.concat(F.array(F.lit("menu"), F.lit("login"), F.concat(F.lit("Notice: "), F.coalesce("source", F.lit("")))), F.split("text", "\n"), F.array(F.lit("등록일"), date, F.lit("조회수 12"), F.lit("Next: other"), F.lit("tail")))
    found = docs.select("doc_id", lines.alias("lines")).select("doc_id", tx.notice_body(F.col("lines"), "Notice", ["Next:"], "등록일", ["조회수"]).alias("found"))
    return found.select("doc_id", F.md5("found.body").alias("body"), F.col("found.published").alias("published"))


@query("str06_header_fields", """select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, regexp_extract(url, '([0-9]+)', 1) as number from pages""")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"))


@query("str10_str13_normalized", "select doc_id, md5(lower(regexp_replace(text, '[^0-9A-Za-z가-힣]', '', 'g'))) as h from documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.md5(tx.alnum(F.col("text"))).alias("h"))


@query("str11_identity_match", "select c_custkey, starts_with(lower(replace(c_name, 'Customer', 'cust')), 'cust#') as same from customer")
def _(spark, sf):
    return t(spark, sf, "customer").select("c_custkey", F.startswith(F.lower(F.replace("c_name", F.lit("Customer"), F.lit("cust"))), F.lit("cust#")).alias("same"))


@query("str12_number_sets", "select event_id, list_sort(list_distinct(regexp_extract_all(props, '[0-9]+'))) as numbers from events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", F.array_sort(F.array_distinct(F.regexp_extract_all("props", F.lit("([0-9]+)"), 1))).alias("numbers"))


@query("str14_whitespace_free", r"select doc_id, length(regexp_replace(text, '\s+', '', 'g'))::bigint as n from documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.length(F.regexp_replace("text", r"\s+", "")).cast("long").alias("n"))


@query("str16_mask_sensitive")
def _(spark, sf):
    masked = tx.mask_sensitive(F.col("text"))
    return t(spark, sf, "documents").select("doc_id", (masked != F.col("text")).alias("changed"), F.md5(masked).alias("h"))


@query("str17_compact_copy", r"select doc_id, md5(case when regexp_replace(text, '\s', '', 'g') = text then text else text || chr(10) || regexp_replace(text, '\s', '', 'g') end) as h from documents")
def _(spark, sf):
    small = F.regexp_replace("text", r"\s", "")
    return t(spark, sf, "documents").select("doc_id", F.md5(F.when(small == F.col("text"), F.col("text")).otherwise(F.concat("text", F.lit("\n"), small))).alias("h"))


KINDS = [("en", ("the", "and", "of"), 2), ("fr", ("de", "la", "que"), 2)]


@query("str18_document_kind", "select doc_id, " + ", ".join(f"({' + '.join(f'''{w} * contains(text, ' {x} ')::int''' for x in ws)})::bigint as {n}_score" for n, ws, w in KINDS) + ", case when " + " + ".join(f"2 * contains(text, ' {x} ')::int" for x in KINDS[0][1]) + " >= " + " + ".join(f"2 * contains(text, ' {x} ')::int" for x in KINDS[1][1]) + " + 2 then 'en' else 'other' end as kind from documents")
def _(spark, sf):
    score = {n: sum((F.contains("text", F.lit(f" {x} ")).cast("int") * w for x in ws), F.lit(0)) for n, ws, w in KINDS}
    return t(spark, sf, "documents").select("doc_id", *[s.cast("long").alias(f"{n}_score") for n, s in score.items()], F.when(score["en"] >= score["fr"] + 2, "en").otherwise("other").alias("kind"))


@query("str21_clauses", "select doc_id, regexp_matches(text, '(?i)licensed under') as has_license, len(regexp_extract_all(text, '(?i)licensed under'))::bigint as n from documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.rlike("text", F.lit("(?i)licensed under")).alias("has_license"), F.regexp_count("text", F.lit("(?i)licensed under")).cast("long").alias("n"))


@query("str22_k_of_n", "select doc_id from documents where (contains(text, ' the ')::int + contains(text, ' of ')::int + contains(text, ' and ')::int + contains(text, ' is ')::int) >= 3")
def _(spark, sf):
    n = sum((F.contains("text", F.lit(f" {w} ")).cast("int") for w in ("the", "of", "and", "is")), F.lit(0))
    return t(spark, sf, "documents").where(n >= 3).select("doc_id")


@query("str26_best_excerpt", r"with s as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) select doc_id, arg_max(line, (contains(line, 'the')::int + contains(line, 'of')::int, -pos)) as line from s group by 1")
def _(spark, sf):
    rows = t(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    score = F.contains("line", F.lit("the")).cast("int") + F.contains("line", F.lit("of")).cast("int")
    return rows.groupBy("doc_id").agg(F.max_by("line", F.struct(score, -F.col("pos"))).alias("line"))


@query("str34_deep_link", "select doc_id, case lang when 'en' then 'https://example.org/' || source || '/' || doc_id when 'de' then 'https://example.net/' || doc_id end as link from documents")
def _(spark, sf):
    i = F.col("doc_id").cast("string")
    return t(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "en", F.concat(F.lit("https://example.org/"), "source", F.lit("/"), i)).when(F.col("lang") == "de", F.concat(F.lit("https://example.net/"), i)).alias("link"))


@query("str35_safe_rewrite", "select conv_id, turn, len(list_filter(list_distinct(regexp_extract_all(text, '[0-9]+')), lambda x: not contains(prev, x))) = 0 as safe from (select *, coalesce(lag(text) over (partition by conv_id order by turn), '') as prev from conversations)")
def _(spark, sf):
    rows = t(spark, sf, "conversations").withColumn("prev", F.coalesce(F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), F.lit("")))
    fresh = F.filter(F.regexp_extract_all("text", F.lit("([0-9]+)"), 1), lambda x: ~F.contains(F.col("prev"), x))
    return rows.select("conv_id", "turn", (F.size(fresh) == 0).alias("safe"))


@query("str36_title_overlap", "select item_id, len(list_filter(list_distinct(string_split(text, ' ')), lambda w: contains(regexp_extract(text, '^[^.?!]*'), substr(w, 1, 2))))::bigint as n from benchmark")
def _(spark, sf):
    """Words of a question that are, with their first two letters, in its title: the whole first sentence."""
    own = F.filter(F.array_distinct(F.split("text", " ")), lambda w: F.contains(F.regexp_extract("text", r"^[^.?!]*", 0), F.substring(w, 1, 2)))
    return t(spark, sf, "benchmark").select("item_id", F.size(own).cast("long").alias("n"))


@query("str37_short_title", r"select conv_id, turn, case when trim(text) = '' then 'untitled' when length(s) <= 24 then s else substr(s, 1, 23) || '…' end as title from (select *, trim(regexp_replace(text, '[\s\x{00a0}]+', ' ', 'g')) as s from conversations where role = 'user')")
def _(spark, sf):
    s = tx.squeeze(F.col("text"))
    return t(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.when(F.trim("text") == "", "untitled").when(F.length(s) <= 24, s).otherwise(F.concat(F.substring(s, 1, 23), F.lit("…"))).alias("title"))


# ---- dates, numbers, JSON ------------------------------------------------------


@query("dat01_day_of_digits", r"select o_orderkey, case when length(d) = 8 then d[1:4] || '-' || d[5:6] || '-' || d[7:8] else '' end as day from (select o_orderkey, substr(regexp_replace(o_orderdate::varchar, '\D', '', 'g'), 1, 8) as d from orders)")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", tx.iso_day(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("day"))


@query("dat02_calendar_check", "select p_partkey, try_cast('2024-' || lpad((p_size % 14)::varchar, 2, '0') || '-' || lpad((p_partkey % 33)::varchar, 2, '0') as date) is not null as valid from part")
def _(spark, sf):
    text = F.concat(F.lit("2024-"), F.lpad((F.col("p_size") % 14).cast("string"), 2, "0"), F.lit("-"), F.lpad((F.col("p_partkey") % 33).cast("string"), 2, "0"))
    return t(spark, sf, "part").select("p_partkey", F.try_to_date(text, "yyyy-MM-dd").isNotNull().alias("valid"))


@query("dat03_shape_check", "select page_id, regexp_matches(url, '^https?://[a-z0-9.-]+/[a-z]{2}/[0-9]+$') as ok from pages")
def _(spark, sf):
    return t(spark, sf, "pages").select("page_id", F.rlike("url", F.lit("^https?://[a-z0-9.-]+/[a-z]{2}/[0-9]+$")).alias("ok"))


@query("dat05_stale", "select o_orderkey, date_diff('day', o_orderdate::date, date '1998-01-01') > 30 as stale from orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", (F.datediff(F.lit("1998-01-01").cast("date"), F.to_date("o_orderdate")) > 30).alias("stale"))


@query("dat07_calendar_time", "select o_orderkey, o_orderdate::date + interval 9 hour as at from orders")
def _(spark, sf):
    return t(spark, sf, "orders").select("o_orderkey", F.expr("cast(to_date(o_orderdate) as timestamp) + interval 9 hours").alias("at"))


@query("num02_unit_amount", r"select event_id, (coalesce(try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as bigint), 0) * 10000 + floor(value))::bigint as amount from events where value is not null")
def _(spark, sf):
    k = F.coalesce(F.expr(r"try_cast(nullif(regexp_extract(props, '([0-9]+)', 1), '') as bigint)"), F.lit(0))
    return t(spark, sf, "events").where("value is not null").select("event_id", (k * 10000 + F.floor("value")).cast("long").alias("amount"))


@query("num04_number_tokens", "select doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[0-9][0-9,]*'), lambda x: replace(x, ',', '')))) as numbers from documents")
def _(spark, sf):
    return t(spark, sf, "documents").select("doc_id", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit("([0-9][0-9,]*)"), 1), lambda x: F.replace(x, F.lit(","), F.lit(""))))).alias("numbers"))


@query("jsn02_digest", "select event_id, sha256('{\"event_type\":' || coalesce('\"' || event_type || '\"', 'null') || ',\"user_id\":' || coalesce(user_id::varchar, 'null') || '}') as h from events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id"), {"ignoreNullFields": "false"}), 256).alias("h"))


@query("jsn03_json_object", "select event_id, json_extract_string(regexp_extract(props, '\\{.*\\}'), '$.k') as k from events")
def _(spark, sf):
    return t(spark, sf, "events").select("event_id", F.get_json_object(F.regexp_extract("props", r"\{.*\}", 0), "$.k").alias("k"))


@query("jsn05_stable_code", "select doc_id, coalesce(nullif(lower(regexp_replace(source, '[^A-Za-z]', '', 'g')), 'src'), substr(sha256(text), 1, 16)) as code from documents")
def _(spark, sf):
    slug = F.lower(F.regexp_replace("source", "[^A-Za-z]", ""))
    return t(spark, sf, "documents").select("doc_id", F.coalesce(F.nullif(slug, F.lit("src")), F.substring(F.sha2("text", 256), 1, 16)).alias("code"))


@query("jsn06_priority", "select event_id, least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') as int), 50), 1), 100) as priority from events")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t(spark, sf, "events").select("event_id", F.least(F.greatest(F.coalesce(k, F.lit(50)), F.lit(1)), F.lit(100)).alias("priority"))


@query("jsn07_messages_digest", "select conv_id, sha256(string_agg(role || ':' || text, chr(10) order by turn)) as h from conversations group by 1")
def _(spark, sf):
    listed = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(":"), "text").alias("m"))))
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.sha2(F.array_join(F.transform(listed, lambda s: s["m"]), "\n"), 256).alias("h"))


# ---- sets and rules ------------------------------------------------------------

SETS = "s as (select o_custkey as qid, list(distinct o_orderkey % 10) as got, list(distinct (o_orderkey + o_custkey) % 10) as want from orders group by 1)"


def _sets(spark, sf):
    return t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("qid")).agg(F.collect_set(F.col("o_orderkey") % 10).alias("got"), F.collect_set((F.col("o_orderkey") + F.col("o_custkey")) % 10).alias("want"))


@query("set04_set05_any_all_missing", f"with {SETS} select qid, list_has_any(got, want) as any_hit, list_has_all(got, want) as all_hit, list_sort(list_filter(want, lambda x: not list_contains(got, x))) as absent from s")
def _(spark, sf):
    absent = F.array_sort(F.array_except("want", "got"))
    return _sets(spark, sf).select("qid", F.arrays_overlap("got", "want").alias("any_hit"), (F.size(absent) == 0).alias("all_hit"), absent.alias("absent"))


@query("set06_join_channels", "select doc_id from documents where lang = 'en' union select doc_id from documents where lang = 'fr' or source = 'src3'")
def _(spark, sf):
    d = t(spark, sf, "documents")
    return d.where("lang = 'en'").select("doc_id").union(d.where("lang = 'fr' or source = 'src3'").select("doc_id")).distinct()


@query("set07_set08_item_score", f"with {SETS} select qid, len(list_filter(want, lambda x: not list_contains(got, x))) = 0 as complete, len(list_filter(got, lambda x: not list_contains(want, x)))::bigint as outside from s")
def _(spark, sf):
    return _sets(spark, sf).select("qid", (F.size(F.array_except("want", "got")) == 0).alias("complete"), F.size(F.array_except("got", "want")).cast("long").alias("outside"))


@query("set09_set11_categories", f"with {SETS} select qid, case when not list_has_any(got, want) then 'none' when list_has_all(got, want) and list_has_all(want, got) then 'equal' when list_has_all(got, want) then 'complete' else 'partial' end as category from s")
def _(spark, sf):
    miss, extra = F.size(F.array_except("want", "got")), F.size(F.array_except("got", "want"))
    return _sets(spark, sf).select("qid", F.when(~F.arrays_overlap("got", "want"), "none").when((miss == 0) & (extra == 0), "equal").when(miss == 0, "complete").otherwise("partial").alias("category"))


@query("set12_gold_recall", f"with {SETS} select qid, case when len(want) = 0 then null else round(len(list_intersect(got, want))::double / len(want), 6) end as recall from s")
def _(spark, sf):
    return _sets(spark, sf).select("qid", F.when(F.size("want") > 0, F.round(F.size(F.array_intersect("got", "want")) / F.size("want"), 6)).alias("recall"))


@query("rul04_sufficient_evidence", "select conv_id, bool_or(role = 'assistant' and length(text) > 100) as enough from conversations group by 1")
def _(spark, sf):
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & (F.length("text") > 100)).alias("enough"))


@query("rul12_tri_state_checks", "select doc_id, case when quality is null or toxic is null then null else quality = 1 and toxic = 0 end as passed, d.lang is not null as observed from labels left join (select doc_id, lang from documents where lang <> 'en') d using (doc_id)")
def _(spark, sf):
    d = t(spark, sf, "documents").where("lang <> 'en'").select("doc_id", "lang")
    return t(spark, sf, "labels").join(d, "doc_id", "left").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("passed"), F.col("lang").isNotNull().alias("observed"))


@query("rul13_rul21_failure_stage", "select event_id, case event_type when 'purchase' then 'answered' when 'click' then 'generation' when 'view' then 'retrieval' else 'unknown' end as stage from events")
def _(spark, sf):
    e = F.col("event_type")
    return t(spark, sf, "events").select("event_id", F.when(e == "purchase", "answered").when(e == "click", "generation").when(e == "view", "retrieval").otherwise("unknown").alias("stage"))


# ---- keyed state ---------------------------------------------------------------


@query("stm01_dialogue_state", """with u as (select conv_id, turn, text, sum((length(text) < 60)::int) over (partition by conv_id order by turn) as epoch from conversations where role = 'user'),
l as (select conv_id, count(*)::bigint as turns, max(epoch)::bigint as epoch, arg_max(text, turn) as last_user from u group by 1),
k as (select * from u qualify row_number() over (partition by conv_id, epoch order by turn desc) <= 4)
select l.conv_id, l.turns, l.epoch, l.last_user, list(k.text order by k.turn) as history from l join k on k.conv_id = l.conv_id and k.epoch = l.epoch group by all""")
def _(spark, sf):
    return dialogue.fold_conversations(t(spark, sf, "conversations"))


@query("stm05_once_per_request", "select user_id, count(distinct event_type)::bigint as requests from events group by 1")
def _(spark, sf):
    rows = t(spark, sf, "events").withColumn("request", F.concat_ws(":", F.coalesce(F.col("user_id").cast("string"), F.lit("")), "event_type"))
    return dialogue.once_per_request(rows, "request", "ts").groupBy("user_id").agg(F.count("event_type").alias("requests"))


@query("stm04_stm06_expiry", "select event_id from events where ts < (select max(ts) from events) - interval 7 day")
def _(spark, sf):
    e = t(spark, sf, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("last")))).where("ts < last - interval 7 days").select("event_id")


@query("stm07_distinct_days", "select event_type, list_sort(list_distinct(list(day(ts)))) as days from events group by 1")
def _(spark, sf):
    return t(spark, sf, "events").groupBy("event_type").agg(F.array_sort(F.collect_set(F.dayofmonth("ts").cast("long"))).alias("days"))


@query("stm09_last_messages", "select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 3")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t(spark, sf, "conversations").withColumn("r", F.row_number().over(w)).where("r <= 3").select("conv_id", "turn", "role", "text")


@query("stm12_last_answer", "select conv_id, arg_max(text, turn) filter (role = 'assistant' and length(text) > 200) as last_answer from conversations group by 1")
def _(spark, sf):
    ok = (F.col("role") == "assistant") & (F.length("text") > 200)
    return t(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", F.when(ok, F.col("turn"))).alias("last_answer"))


@query("rnk29_recent_pairs", "select conv_id, turn, text as ask, answer from (select *, lead(text) over (partition by conv_id order by turn) as answer, lead(role) over (partition by conv_id order by turn) as next_role from conversations) where role = 'user' and next_role = 'assistant' qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    pairs = t(spark, sf, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w)).where("role = 'user' and next_role = 'assistant'")
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return pairs.withColumn("r", last).where("r <= 2").select("conv_id", "turn", F.col("text").alias("ask"), "answer")
