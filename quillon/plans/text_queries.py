"""Queries over texts: projections, parsing, keys and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.catalog import Tables, query
from quillon.functions import text as T
from quillon.operators import segment as S

WORDS_SQL = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


@query(rf"""with w as (select doc_id, {WORDS_SQL} as w from documents),
c as (select doc_id, w, unnest(range(0, (len(w) + 99) // 100)) as chunk_no from w)
select doc_id, doc_id || '_' || lpad(cast(chunk_no as varchar), 4, '0') as chunk_id, cast(chunk_no as int) as chunk_no, array_to_string(w[chunk_no * 100 + 1 : chunk_no * 100 + 100], ' ') as text from c""")
def word_chunks(t: Tables) -> DataFrame:
    return S.word_chunks(t.documents, 100)


SENTENCES_SQL = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@query(f"with s as (select doc_id, {SENTENCES_SQL} as s from documents) select doc_id, cast(unnest(range(len(s))) as int) as sentence_no, unnest(s) as sentence from s")
def sentence_split(t: Tables) -> DataFrame:
    return S.sentence_rows(t.documents)


@query(r"select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')) as n_tokens from documents")
def lexical_tokens(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("select doc_id, trim(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' ') as processed from documents")
def text_processing(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.processed(F.col("text")).alias("processed"))


@query(r"""select doc_id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'), '\s+'), lambda w: w not in ('', 'a', 'an', 'the')), ' ') as answer from documents where lang = 'en'""")
def normalize_answer(t: Tables) -> DataFrame:
    return t.documents.where(F.col("lang") == "en").select("doc_id", T.normalized_answer(F.col("text")).alias("answer"))


ANCHORS_SQL = r"""select page_id, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="(.*?)"[^>]*>(.*?)</a>', 1)) as href, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href="(.*?)"[^>]*>(.*?)</a>', 2)) as label from pages"""


@query(ANCHORS_SQL)
def page_anchors(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.explode(T.anchors(F.col("html"))).alias("a")).select("page_id", "a.href", F.col("a.text").alias("label"))


@query(rf"""with a as ({ANCHORS_SQL}), p as (select page_id, nullif(trim(url_decode(regexp_replace(regexp_replace(string_split(href, '/')[-1], '#.*', ''), '\?.*', ''))), '') as part from a)
select part, count(*) as n from p where part is not null group by part""")
def link_targets(t: Tables) -> DataFrame:
    links = t.pages.select(F.explode(T.anchors(F.col("html"))).alias("a")).select(T.href_part(F.col("a.href")).alias("part"))
    return links.where("part is not null").groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query()
def link_references(t: Tables) -> DataFrame:
    """Anchors as text\\ref{slug}, then the references taken out again."""
    links = t.pages.select("page_id", F.posexplode(T.anchors(F.col("html"))).alias("pos", "a")).withColumn("slug", T.slug(T.href_part(F.col("a.href"))))
    made = F.when(F.col("slug").isNull(), F.col("a.text")).otherwise(F.concat(F.col("a.text"), F.lit("\\ref{"), "slug", F.lit("}")))
    return links.select("page_id", "pos", made.alias("marked")).select("*", T.without_refs(F.col("marked")).alias("plain"), F.array_join(T.refs(F.col("marked")), "|").alias("refs"))


@query("select page_id, regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^www\\.', '') as domain from pages")
def page_domain(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.domain(F.col("url")).alias("domain"))


@query()
def page_text(t: Tables) -> DataFrame:
    """Whole pages as text with references, entities decoded."""
    return t.pages.select("page_id", T.plain_html(F.col("html")).alias("text"), T.unescaped(T.tags_but_links_removed(F.col("html"))).alias("linked"))


@query("select doc_id, 'chunk-' || md5(text) as hash_id, sha256(lower(trim(source)) || '|' || lower(trim(lang)) || '|' || lower(trim(text))) as assertion_id from documents")
def content_ids(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.content_id("chunk-", F.col("text")).alias("hash_id"), T.assertion_id(F.col("source"), F.col("lang"), F.col("text")).alias("assertion_id"))


@query(rf"select doc_id, case when text = '' then 0 else greatest(1, cast(round_even(len({WORDS_SQL}) / 0.75, 0) as int)) end as tokens from documents")
def token_estimate(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.estimated_tokens(F.col("text")).alias("tokens"))


@query(rf"""with w as (select unnest({WORDS_SQL}) as word from documents), d as (select distinct word from w)
select word from d where length(regexp_replace(word, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 2 and upper(trim(word)) not in ('AND', 'OR', 'NOT')""")
def valid_entity(t: Tables) -> DataFrame:
    return t.documents.select(F.explode(T.words(F.col("text"))).alias("word")).distinct().where(T.is_valid_entity(F.col("word")))


@query(rf"""with q as (select item_id, text, regexp_split_to_array(text, '\s+') as w from benchmark), u as (select item_id, unnest(w) as term, unnest(range(len(w))) as pos from q),
f as (select item_id, term, min(pos) as pos from u where length(regexp_replace(term, '[^\p{{L}}\p{{N}}]', '', 'g')) >= 2 and upper(trim(term)) not in ('AND', 'OR', 'NOT') group by item_id, term)
select item_id, string_agg(term, ' ' order by pos) as terms from f group by item_id""")
def query_terms(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", F.array_join(T.search_terms(F.array().cast("array<string>"), F.col("text")), " ").alias("terms"))


_KNOWN = "[" + ", ".join(f"'{x}'" for x in T.BIOMEDICAL_TERMS) + "]"


@query(rf"""select doc_id, array_to_string(list_concat(list_filter({_KNOWN}, lambda k: contains(lower(text), k)), list_transform(list_filter({WORDS_SQL},
lambda w: length(w) > 4 and regexp_full_match(w, '\p{{L}}+') and (regexp_matches(w, '^\p{{Lu}}') or regexp_matches(w, '({"|".join(T.BIOMEDICAL_SUFFIXES)})$'))), lambda w: lower(w)))[1:5], ' ') as keywords from documents""")
def keyword_extract(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.array_join(T.biomedical_keywords(F.col("text")), " ").alias("keywords"))


@query("select doc_id, substring(trim(regexp_replace(regexp_replace(text, '[<>:\"/\\\\|?*]', '_', 'g'), '_+', '_', 'g'), '_'), 1, 200) as name from documents")
def safe_filenames(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.safe_filename(F.col("text")).alias("name"))


@query(r"""select item_id, replace(regexp_replace(text, '([+\-&|!(){}\[\]^"~*?:\\/])', chr(1) || '\1', 'g'), chr(1), chr(92)) as escaped from benchmark""")
def lucene_escape(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.escaped_for_lucene(F.col("text")).alias("escaped"))


@query("select event_id, string_split(string_split(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'T')[1], '-')[1] as year, cast(ts as date) as day from events")
def publication_dates(t: Tables) -> DataFrame:
    iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    return t.events.select("event_id", T.publication_year(iso).alias("year"), F.try_to_date(F.split(iso, "T")[0]).alias("day"))


@query(r"""with m as (select c_custkey, '{''' || c_name || ''',''owes'',''' || c_mktsegment || '''} and {'' a '','' b '','' c ''}' as answer from customer)
select c_custkey, string_agg(s || '/' || r || '/' || o, ';' order by pos) as triplets from (select c_custkey, unnest(['x', 'y']) as pos, unnest([regexp_extract(answer, '\{''(.*?)'',', 1), 'a']) as s, unnest(['owes', 'b']) as r, unnest([regexp_extract(answer, '''owes'',''(.*?)''\}', 1), 'c']) as o from m) group by c_custkey""")
def triplet_parse(t: Tables) -> DataFrame:
    answer = F.concat(F.lit("{'"), "c_name", F.lit("','owes','"), "c_mktsegment", F.lit("'} and {' a ',' b ',' c '}"))
    found = T.parsed_triplets(answer)
    return t.customer.select("c_custkey", F.array_join(F.transform(found, lambda x: F.concat_ws("/", x["subject"], x["relationship"], x["object"])), ";").alias("triplets"))


@query(r"""select doc_id, coalesce(nullif(regexp_extract(text, '\b([A-Z])\b', 1), ''), text) as label, trim(regexp_replace('<think>' || source || '</think> ' || lang, '(?s)<think>.*?</think>', '', 'g')) as said,
coalesce(trim(string_split('So. Answer: ' || source, 'Answer:')[2]), '') as answer from documents where lang = 'en'""")
def answer_parsing(t: Tables) -> DataFrame:
    docs = t.documents.where(F.col("lang") == "en")
    return docs.select("doc_id", T.mc_label(F.col("text")).alias("label"), T.without_thoughts(F.concat(F.lit("<think>"), "source", F.lit("</think> "), "lang")).alias("said"), T.after_answer(F.concat(F.lit("So. Answer: "), "source")).alias("answer"))


@query("""select n_nationkey, coalesce(case n_name when 'PER' then 'Person' when 'LOC' then 'Location' when 'MISC' then 'Miscellaneous' when 'ORG' then 'Organization' end, n_name) as entity_type,
contains(lower(trim(n_name)), 'alias') or contains(lower(trim(n_name)), 'also known as') or lower(trim(n_name)) in ('aka', 'a.k.a.', 'a.k.a', 'same as', 'synonym', 'nickname') as is_alias from nation""")
def entity_types(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", T.entity_type(F.col("n_name")).alias("entity_type"), T.is_alias_relation(F.col("n_name")).alias("is_alias"))


@query("""with g as (select user_id, event_type, min(event_id) as first from events group by user_id, event_type)
select user_id, string_agg(event_type, ',' order by first) as types from g group by user_id""")
def grouped_entities(t: Tables) -> DataFrame:
    """Entities by type, types in order of appearance."""
    own = t.events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))).alias("e"))
    maps = own.select("user_id", T.grouped_entities(F.transform("e", lambda x: x["event_id"].cast("string")), F.transform("e", lambda x: x["event_type"])).alias("m"))
    return maps.select("user_id", F.array_join(F.map_keys("m"), ",").alias("types"))


@query("""select o_orderkey, case when s = 0 then '0s' else trim(case when s // 3600 > 0 then (s // 3600) || 'h' else '' end || case when s % 3600 // 60 > 0 then ' ' || (s % 3600 // 60) || 'm' else '' end || case when s % 60 > 0 and s // 3600 = 0 then ' ' || (s % 60) || 's' else '' end) end as duration,
case when o_orderkey >= 1000 then printf('%.1fk', ((o_orderkey + 50) // 100) / 10.0) else cast(o_orderkey as varchar) end as tokens from (select *, o_orderkey * 7 % 20000 as s from orders)""")
def readable_numbers(t: Tables) -> DataFrame:
    s = F.col("o_orderkey") * 7 % 20000
    return t.orders.select("o_orderkey", T.duration(s).alias("duration"), T.short_count(F.col("o_orderkey")).alias("tokens"))


@query(r"""with c as (select conv_id, list(trim(text) order by turn) as chunks from conversations where role = 'assistant' group by conv_id), q as (select conv_id, arg_min(text, turn) as question from conversations where role = 'user' group by conv_id)
select conv_id, 'USER QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'Choices:' || chr(10) || 'A. yes' || chr(10) || 'B. no' as prompt, array_to_string(list_transform(list_zip(chunks, range(1, len(chunks) + 1)), lambda x: x[2] || '. ' || x[1])[1:5], chr(10)) as context from q join c using (conv_id)""")
def mc_prompts(t: Tables) -> DataFrame:
    c = t.conversations
    chunks = c.where("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("chunks"))
    asked = c.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")).join(chunks, "conv_id")
    prompt = T.mc_prompt(F.col("question"), F.array(F.lit("A"), F.lit("B")), F.array(F.lit("yes"), F.lit("no")), F.col("chunks"))
    made = asked.select("conv_id", prompt.alias("p"))
    return made.select("conv_id", F.col("p")[1]["content"].alias("prompt"), F.split(F.col("p")[0]["content"], "CONTEXT:\n", 2)[1].alias("context"))


@query("""with c as (select conv_id, list(text order by turn) as p from conversations where role = 'assistant' group by conv_id)
select conv_id, array_to_string(list_transform(p, lambda x: 'Wikipedia Title: ' || x || chr(10) || chr(10)), '') || 'Question: why?' || chr(10) || 'Thought: ' as prompt, 'Dear ' || conv_id || ', bye' as letter from c""")
def open_prompts(t: Tables) -> DataFrame:
    c = t.conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("p"))
    return c.select("conv_id", T.passages_prompt(F.lit("why?"), F.col("p")).alias("prompt"), T.filled(F.lit("Dear ${name}, bye"), {"name": F.col("conv_id").cast("string")}).alias("letter"))


@query()
def contextual_chunks(t: Tables) -> DataFrame:
    return S.contextual_chunks(t.documents, 120, 110, 130, 10)


@query()
def token_splits(t: Tables) -> DataFrame:
    return S.token_splits(t.documents, 100, 20)


@query(r"""with n as (select doc_id, len(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda w: w <> '')) as n from documents),
w as (select doc_id, n, unnest(range(0, (n + 511) // 512)) as window_no from n) select doc_id, cast(window_no as int) as window_no, cast(least(512, n - window_no * 512) as int) as n_tokens from w""")
def token_windows(t: Tables) -> DataFrame:
    return S.token_windows(t.documents, 512)


@query(rf"select doc_id, array_to_string({WORDS_SQL}, ' ') as text from documents where len({WORDS_SQL}) > 0")
def text_from_chunks(t: Tables) -> DataFrame:
    return S.rebuilt(S.word_chunks(t.documents, 100))


@query("""with h as (select string_split(text, chr(10))[1] as title, doc_id, substring(text, length(string_split(text, chr(10))[1]) + 2) as body from documents)
select title, min(doc_id) as first_doc, md5(string_agg(body, chr(10) order by doc_id)) as body_md5 from h group by title""")
def merged_by_first_line(t: Tables) -> DataFrame:
    """Passages with the same first line as one, bodies in order."""
    first = F.split("text", "\n")[0]
    own = t.documents.select("doc_id", first.alias("title"), F.expr("substring(text, length(split(text, '\n')[0]) + 2)").alias("body"))
    bodies = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "body"))), lambda x: x["body"])
    return own.groupBy("title").agg(F.min("doc_id").alias("first_doc"), F.md5(F.array_join(bodies, "\n")).alias("body_md5"))


@query("select count(*) as documents, cast(sum(floor(w * 1.3)) as bigint) as tokens, cast(sum(ceil(floor(w * 1.3) / 1200)) as bigint) as chunks from (select len(%s) as w from documents)" % WORDS_SQL)
def dataset_profile(t: Tables) -> DataFrame:
    n = F.floor(F.size(T.words(F.col("text"))) * 1.3)
    return t.documents.select(n.alias("n")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("tokens"), F.sum(F.ceil(F.col("n") / 1200)).alias("chunks"))
