"""The registered queries of this package and their SQL.

Each ``opN_`` query applies operator N with its production parameters to whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siegelog.llm import (
    collocations,
    conversation_trie,
    embeddings,
    hash_tree,
    html_pages,
    mixing,
    ngram_join,
    oracles,
    packing,
    pseudonyms,
    quality,
    secret_forest,
    trie_lm,
    url_lists,
)

# The secret of the pseudonyms; a deployment passes its own.
KEY = "siegelog"
MIX_SHARE, MIX_EPOCHS = 0.8, 4
MIX_WEIGHTS = {"crawl": 1.0, "web": 2.0, "curated": 1.0, "web/de": 2.0}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def domain_of(source: Column) -> Column:
    """The top of the mixing tree: src0 is a crawl, src1 to src9 are the web, the others curated."""
    return F.when(source == "src0", "crawl").when(F.length(source) == 4, "web").when(source.isNotNull(), "curated")


def _number(text: Column) -> Column:
    """A number below 16^6 that follows from a text."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def _day(text: Column) -> Column:
    return F.timestamp_add("DAY", _number(text) % 365, F.lit("2024-01-01").cast("timestamp_ntz"))


def captures(pages: DataFrame) -> DataFrame:
    """Each page with a day of 2024 as its fetch time, which follows from the URL."""
    return pages.select("page_id", "url", _day(F.concat(F.lit("fetch|"), "url")).alias("fetched"))


def list_changes(pages: DataFrame) -> DataFrame:
    """A dated list: four changes in 2024 for each host, each domain of two labels and each host with a first part of the path."""
    host = url_lists.host_of(F.col("url"))
    part = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    domain = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    patterns = F.array(host, domain, F.when(part != "", F.concat_ws("/", host, part)))
    each = pages.select(F.explode(F.array_distinct(patterns)).alias("pattern")).filter("pattern <> ''").distinct()
    each = each.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("own", F.concat_ws("|", "pattern", "k"))
    kind = _number(F.concat("own", F.lit("|c"))) % 3
    return each.select(
        "pattern",
        F.when(kind == 0, "ads").when(kind == 1, "adult").otherwise("malware").alias("category"),
        (_number(F.concat("own", F.lit("|a"))) % 2 == 0).alias("active"),
        _day(F.concat("own", F.lit("|t"))).alias("at"),
    )


def op1_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymised(_table(spark, sf_dir, "documents"), KEY).select("doc_id", "text", "n_replaced")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_documents(_table(spark, sf_dir, "documents"))


def op4_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_tree.sharded(_table(spark, sf_dir, "documents"), hash_tree.Tree.even(16))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"))


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in documents of ``labels`` are the labelled ones, where a rule for their kind tells."""
    found = secret_forest.findings(_table(spark, sf_dir, "documents"))
    known = _table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("known", F.lit(True))
    found = secret_forest.rule_label(found).join(known, "doc_id", "left").withColumn("label", F.when(F.col("known"), F.col("label"))).drop("known")
    return secret_forest.scanned(found).select(
        "doc_id", "place", F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").alias("length"), "label", "probability", "kept"
    )


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op8_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_lists.evaluated(captures(pages), list_changes(pages))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mixed(_table(spark, sf_dir, "documents"), MIX_SHARE, MIX_WEIGHTS, domain_of(F.col("source")), max_epochs=MIX_EPOCHS)
    return mixed.select("doc_id", "leaf", "epoch", "tokens", "tokens_taken")


def op10_trie_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_lm.score_documents(_table(spark, sf_dir, "documents"))


def op11_html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_pages.main_texts(_table(spark, sf_dir, "pages"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("node", "parent_node")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pseudonyms,
        op2_packing,
        op3_ngram_join,
        op4_hash_tree,
        op5_quality,
        op6_secret_forest,
        op7_embeddings,
        op8_url_lists,
        op9_mixing,
        op10_trie_lm,
        op11_html_pages,
        op12_conversation_trie,
        op13_collocations,
    )
}

SQL: dict[str, str] = {
    "op3_ngram_join": r"""
        with recursive tokens as (
            select doc_id, [x for x in string_split_regex(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x20\x09-\x0D]+') if x <> ''] as w
            from documents
        ),
        shingles as (
            select distinct doc_id, unnest(case
                when len(w) = 0 then []
                when len(w) < 5 then [array_to_string(w, ' ')]
                else [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] end) as s,
                len(w) < 5 as whole
            from tokens
        ),
        sizes as (select doc_id, count(*) as n from shingles group by doc_id),
        pairs as (
            select a.doc_id as a, b.doc_id as b, count(*) as both_have
            from shingles a join shingles b on a.s = b.s and a.whole = b.whole and a.doc_id < b.doc_id
            group by 1, 2
        ),
        links as (
            select a, b from pairs join sizes x on a = x.doc_id join sizes y on b = y.doc_id
            where 100 * both_have >= 80 * (x.n + y.n - both_have)
        ),
        both_ways as (select a, b from links union all select b, a from links),
        reach(a, b) as (
            select doc_id, doc_id from documents
            union
            select r.a, l.b from reach r join both_ways l on r.b = l.a
        )
        select d.doc_id, coalesce(n, 0)::bigint as n_shingles, min(r.b) as component_id, coalesce(any_value(l.k), 0)::bigint as n_links
        from documents d left join sizes using (doc_id) join reach r on r.a = d.doc_id
        left join (select a, count(*) as k from both_ways group by a) l on l.a = d.doc_id
        group by d.doc_id, n
    """,
    "op7_embeddings": """
        with recursive vectors as (
            select vec_id, embedding::double[] as v from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
        ),
        valid as (
            select * from vectors
            where len([x for x in v if x is null or not isfinite(x)]) = 0 and len([x for x in v if x <> 0]) > 0
        ),
        links as (
            select a.vec_id as a, b.vec_id as b
            from valid a join valid b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
            where list_cosine_similarity(a.v, b.v) >= 0.9
        ),
        reach(a, b) as (
            select vec_id, vec_id from embeddings
            union
            select r.a, l.b from reach r join links l on r.b = l.a
        ),
        n as (select a, count(*) as n from links group by a),
        smallest as (select a, min(b) as component_id from reach group by a)
        select e.vec_id, coalesce(n.n, 0)::bigint as n_links, s.component_id, e.vec_id = s.component_id as kept
        from embeddings e left join n on n.a = e.vec_id join smallest s on s.a = e.vec_id
    """,
    "op8_url_lists": r"""
        with hosts as (
            select page_id, url, lower(regexp_replace(regexp_replace(
                    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')) as host,
                regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) as path,
                regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)', 1) as part
            from pages
        ),
        fetched as (
            select *, timestamp '2024-01-01' + to_days((('0x' || substr(md5('fetch|' || url), 1, 6))::bigint % 365)::int) as fetch_day from hosts
        ),
        patterns as (
            select distinct pattern from (
                select unnest([host, regexp_extract(host, '([^.]+\.[^.]+)$', 1), case when part <> '' then host || '/' || part end]) as pattern from hosts
            ) where pattern <> ''
        ),
        own as (select pattern, pattern || '|' || k as own from patterns, unnest([0, 1, 2, 3]) as t(k)),
        changes as (
            select lower(pattern) as pattern,
                case ('0x' || substr(md5(own || '|c'), 1, 6))::bigint % 3 when 0 then 'ads' when 1 then 'adult' else 'malware' end as category,
                ('0x' || substr(md5(own || '|a'), 1, 6))::bigint % 2 = 0 as active,
                timestamp '2024-01-01' + to_days((('0x' || substr(md5(own || '|t'), 1, 6))::bigint % 365)::int) as since
            from own
        ),
        states as (select pattern, category, since, bool_or(active) as active from changes group by all),
        intervals as (
            select *, lead(since) over (partition by pattern, category order by since) as until from states 
        ),
        keys as (
            select distinct url, fetch_day, host, path, unnest(
                [array_to_string(string_split(host, '.')[i:], '.') for i in range(1, len(string_split(host, '.')) + 1)]
                || [host]
                || [host || '/' || array_to_string([x for x in string_split(path, '/') if x <> ''][1:i], '/')
                    for i in range(1, len([x for x in string_split(path, '/') if x <> '']) + 1)]) as pattern
            from fetched where host <> ''
        ),
        found as (
            select k.url, k.fetch_day, count(*) as n_active, array_to_string(list_sort(list(distinct category)), ',') as categories
            from (select distinct url, fetch_day, pattern from keys) k
            join intervals i on k.pattern = i.pattern and i.active and i.since <= k.fetch_day and (i.until is null or k.fetch_day < i.until)
            group by k.url, k.fetch_day
        )
        select f.page_id, f.url, f.fetch_day as fetched, coalesce(n_active, 0)::bigint as n_active, coalesce(categories, '') as categories
        from fetched f left join found on f.url = found.url and f.fetch_day = found.fetch_day
    """,
    "op9_mixing": r"""
        with docs as (
            select doc_id,
                case when source = 'src0' then 'crawl' when length(source) = 4 then 'web' when source is not null then 'curated' else '(none)' end as d,
                coalesce(lang, '(none)') as l, coalesce(source, '(none)') as s,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as tokens
            from documents
        ),
        leaves as (select d, l, s, sum(tokens)::double * 4 as capacity from docs where tokens > 0 group by all),
        top as (select sum(capacity) * (0.8::double / 4) as b from leaves),
        c1 as (
            select '' as parent, d as path, sum(capacity) as capacity, case when d = 'web' then 2.0 else 1.0 end::double as weight, any_value(b) as b
            from leaves, top group by d
        ),
        {FILL1}
        c2 as (
            select d as parent, d || '/' || l as path, sum(capacity) as capacity,
                case when d || '/' || l = 'web/de' then 2.0 else 1.0 end::double as weight, any_value(budget) as b
            from leaves join f1 on f1.path = d group by d, l
        ),
        {FILL2}
        c3 as (
            select d || '/' || l as parent, d || '/' || l || '/' || s as path, sum(capacity) as capacity, 1.0::double as weight, any_value(budget) as b
            from leaves join f2 on f2.path = d || '/' || l group by d, l, s
        ),
        {FILL3}
        plan as (
            select path as leaf, floor(budget / (cap / 4))::int as whole,
                floor(budget - floor(budget / (cap / 4)) * (cap / 4))::bigint as rest
            from f3
        ),
        ordered as (
            select doc_id, leaf, tokens, whole, rest,
                sum(tokens) over (partition by leaf order by md5('mix|' || whole || coalesce('|' || doc_id, '')), tokens rows unbounded preceding) - tokens as start
            from docs join plan on leaf = d || '/' || l || '/' || s where tokens > 0
        ),
        reads as (
            select doc_id, leaf, e as epoch, tokens, case when e < whole then tokens else least(tokens, rest - start) end as tokens_taken
            from (select *, unnest(range(0, whole + 1)) as e from ordered)
        )
        select doc_id, leaf, epoch::int as epoch, tokens::bigint as tokens, tokens_taken::bigint as tokens_taken from reads where tokens_taken > 0
    """,
}


def _fill(source: str, target: str) -> str:
    """SQL of the shares of siblings: ``target`` has the rows of ``source`` with a budget."""
    before = "over (partition by parent order by capacity / weight, path rows between unbounded preceding and 1 preceding)"
    return f"""
        {target}_levels as (
            select *, (b - coalesce(sum(capacity) {before}, 0)) / (sum(weight) over (partition by parent) - coalesce(sum(weight) {before}, 0)) as level,
                row_number() over (partition by parent order by capacity / weight, path) as place
            from {source}
        ),
        {target} as (
            select path, case when capacity / weight <= level then capacity
                else weight * arg_min(level, place) filter (capacity / weight > level) over (partition by parent) end as budget, capacity as cap
            from {target}_levels
        ),"""


for _k in (1, 2, 3):
    SQL["op9_mixing"] = SQL["op9_mixing"].replace(f"{{FILL{_k}}}", _fill(f"c{_k}", f"f{_k}"))

SQL["op12_conversation_trie"] = oracles.CONVERSATION_TRIE
SQL["op13_collocations"] = oracles.PHRASES
