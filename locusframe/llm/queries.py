"""The thin queries over the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import divergence, license_scan, mining, ngram_join, ogg, packing, pii, simhash, spm, suffix, topk, toxicity, warc
from locusframe.llm.common import documents


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", topk.quantised(F.col("embedding")).alias("ints"))
    return topk.search(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below source/language/hundred; those that are a licence's text speak for their directory."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(F.col("doc_id") / 100))
    files = documents(spark, sf_dir).select("doc_id", F.concat_ws("/", folder, F.concat(F.col("doc_id"), F.lit(".txt"))).alias("path"), "text")
    found = license_scan.scan(files)
    return found.withColumn("score", F.round("score", 6))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.read(spark, warc.archive(pages, min_bytes=0), payloads=False).drop("payload")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~toxicity.held_out("doc_id"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", "predicted")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counts(pii.find(documents(spark, sf_dir)))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.dedupe(documents(spark, sf_dir))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return found.select("doc_id", shown, "component_id")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.digest(ogg.from_text(documents(spark, sf_dir)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(documents(spark, sf_dir), length=400, keep="none")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.select("vec_id", moved.alias("label"), topk.quantised(F.col("embedding")).alias("ints"))
    return mining.mine(rows, F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_license_scan": op2_license_scan,
    "op3_warc": op3_warc,
    "op4_toxicity": op4_toxicity,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_pii": op6_pii,
    "op7_simhash": op7_simhash,
    "op8_media_columns": op8_media_columns,
    "op9_packing": op9_packing,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_source_divergence": op11_source_divergence,
    "op12_ngram_join": op12_ngram_join,
    "op13_hard_negatives": op13_hard_negatives,
}

def license_sql() -> str:
    """The licence scan over all lines, paragraphs and texts, without the trigger filter."""
    m = license_scan.model(license_scan.TEMPLATES, license_scan.THRESHOLD)
    idf = ", ".join(f"('{t}', {x!r}::double)" for t, x in sorted(m.idf.items()))
    weights = ", ".join(
        f"('{k}', {i}, {k in license_scan.FAMILIES}, {(k, i) in m.titles}, {m.limits[k, i]!r}::double, '{t}', {w!r}::double)" for (k, i), v in m.vectors.items() for t, w in sorted(v.items())
    )
    return f"""
        with idf(term, idf) as (values {idf}), weights(license, form, family, title, least, term, w) as (values {weights}),
        files as (
            select doc_id, lower(coalesce(text, '')) as low, coalesce(source, '-') || '/' || coalesce(lang, '-') || '/' || (doc_id // 100) as dir,
                   dir || '/' || doc_id || '.txt' as path
            from documents
        ), units as (
            select doc_id, unit, max(said) as said, max(whole) as whole, max(opens) as opens from (
                select doc_id, unnest(regexp_split_to_array(low, '[\r\n]+')) as unit, 1 as said, 0 as whole, 0 as opens from files
                union all select doc_id, unnest(regexp_split_to_array(low, '{license_scan.GAP}')), 1, 0, 0 from files
                union all select doc_id, low, 1, 1, 0 from files
                union all select doc_id, unnest([array_to_string(ps[:1], '\n'), array_to_string(ps[:2], '\n')]), 0, 0, 1
                    from (select doc_id, list_filter(regexp_split_to_array(low, '{license_scan.GAP}'), lambda p: regexp_matches(p, '[a-z0-9]')) as ps from files)
            ) group by doc_id, unit
        ), numbered as (
            select doc_id, row_number() over () as u, unit, said, whole, opens from units
        ), counts as (
            select doc_id, u, said, whole, opens, term, count(*) as n from (
                select doc_id, u, said, whole, opens, unnest(regexp_extract_all(unit, '[a-z0-9]+(?:\\.[0-9]+)*')) as term from numbered) group by all
        ), norms as (
            select u, sqrt(sum((n * coalesce(idf, {m.unseen!r}::double)) ** 2)) as norm, count(*) as terms from counts left join idf using (term) group by u
        ), dots as (
            select doc_id, u, said, whole, opens, license, form, family, title, least, sum(n * idf * w) as dot from counts join idf using (term) join weights using (term) group by all
        ), formed as (
            select *, row_number() over (partition by u order by score desc, family, license, not title) as rn
            from (select u, doc_id, said, whole, opens, terms, family, title, license, least, floor(dot / norm * 1e9 + 0.5) / 1e9 as score from dots join norms using (u) where norm > 0)
            where score >= least
        ), opened as (
            select distinct doc_id from formed where rn = 1 and opens = 1 and title and not family and score >= {license_scan.STRICT}
        ), said as (
            select f.doc_id, case when f.score >= {license_scan.STRICT} then f.whole when o.doc_id is not null then 1 else 0 end as whole, family, license, score, f.rn
            from formed f left join opened o using (doc_id) where f.said = 1 and f.terms > 1
        ), best as (
            select doc_id, family, license, score, row_number() over (partition by doc_id order by family, score desc, license) as rn,
                   max(whole) over (partition by doc_id) as whole
            from said where rn = 1
        ), own as (
            select f.doc_id, f.path, f.dir, coalesce(b.whole = 1, false) as is_license, b.family, b.license, b.score from files f left join best b on b.doc_id = f.doc_id and b.rn = 1
        ), says as (
            select dir, license, score, row_number() over (partition by dir order by family, score desc, license) as rn from own where is_license
        ), chains as (
            select dir, k as depth, array_to_string(list_slice(string_split(dir, '/'), 1, k), '/') as above
            from (select dir, unnest(range(len(string_split(dir, '/')) + 1)) as k from (select distinct dir from own))
        ), near as (
            select c.dir, c.above, s.license, s.score, row_number() over (partition by c.dir order by c.depth desc) as rn
            from chains c join says s on s.dir = c.above and s.rn = 1
        )
        select o.doc_id, o.path, coalesce(o.license, n.license) as license, round(coalesce(o.score, n.score), 6) as score,
               case when o.license is not null then case when o.is_license then 'file' else 'header' end
                    when n.license is not null then 'directory:' || n.above else 'none' end as origin
        from own o left join near n on n.dir = o.dir and n.rn = 1
    """


ORACLES: dict[str, str] = {
    "op2_license_scan": license_sql(),
    "op1_topk": """
        with v as (
            select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e
            from embeddings
            where vec_id is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select q.vec_id as query_id, c.vec_id,
                   cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
            from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)
            where q.vec_id % 50 = 0
        ), ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 5
    """,
    "op11_source_divergence": """
        with given as (
            select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source,
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text
            from documents
        ), said as (
            select d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from given
        ), kept as (
            select lang, term, count(*) as total from said group by lang, term having count(distinct d) >= 10
        ), groups as (
            select distinct lang, source from given
        ), counts as (
            select lang, source, term, count(*) as n from said join kept using (lang, term) group by all
        ), langs as (
            select lang, count(*) as v, sum(total) as n from kept group by lang
        ), cells as (
            select g.lang, g.source, k.term, k.total, coalesce(c.n, 0) as n, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as whole
            from groups g join kept k using (lang) left join counts c using (lang, source, term)
        ), shares as (
            select c.lang, source, term, c.n, 1 + (1000000000::hugeint * (c.n + 2)) // (whole + 2 * v)::hugeint as p,
                   1 + (1000000000::hugeint * (total + 2)) // (l.n + 2 * v)::hugeint as q
            from cells c join langs l using (lang)
        ), pairs as (
            select g.lang, g.source, o.source as item, coalesce(any_value(s.value), 0) as value
            from groups g join groups o on g.lang = o.lang and g.source <> o.source
            left join (
                select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
                from shares a join shares b using (lang, term) where a.source <> b.source group by all
            ) s on s.lang = g.lang and s.source = g.source and s.item = o.source
            group by all
        ), parts as (
            select lang, source, 'pair' as part, item, value::bigint as value from pairs
            union all select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from shares where n > 0 and p > q
        )
        select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank
        from parts qualify part = 'pair' or rank <= 10
    """,
    "op12_ngram_join": """
        with recursive given as (
            select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
            from documents
        ), sets as (
            select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) <= 4 then [array_to_string(w, ' ')]
                   else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) end)) as g
            from given
        ), sizes as (
            select doc_id, count(*) as n from sets group by doc_id
        ), common as (
            select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.g = b.g and a.doc_id < b.doc_id group by all
        ), links as (
            select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 85 * (p.n + q.n - c)
        ), ways as (
            select x, y from links union all select y, x from links
        ), reached(doc_id, other) as (
            select doc_id, doc_id from given
            union
            select r.doc_id, w.y from reached r join ways w on w.x = r.other
        )
        select r.doc_id, coalesce(any_value(s.n), 0)::bigint as n_shingles, min(other) as component_id
        from reached r left join sizes s on s.doc_id = r.doc_id group by r.doc_id
    """,
    "op13_hard_negatives": """
        with v as (
            select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                   list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as double)) as e
            from embeddings
            where vec_id is not null and label is not null and embedding is not null
              and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
        ), scored as (
            select a.vec_id as anchor_id, a.label = r.label as same, r.vec_id,
                   cast(list_sum(list_transform(list_zip(a.e, r.e), lambda p: p[1] * p[2])) as bigint) as score
            from v a join v r on a.vec_id <> r.vec_id and len(a.e) = len(r.e)
            where a.vec_id % 50 = 0
        ), positives as (
            select anchor_id, vec_id as positive_id, score as positive_score from scored where same
            qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
        )
        select p.anchor_id, p.positive_id,
               cast(row_number() over (partition by p.anchor_id, p.positive_id order by n.score desc, n.vec_id) as integer) as rank,
               n.vec_id as negative_id, p.positive_score, n.score as negative_score
        from positives p join scored n on n.anchor_id = p.anchor_id and not n.same
         and 50 * p.positive_score <= 100 * n.score and 100 * n.score <= 95 * p.positive_score
        qualify rank <= 3
    """,
    "op3_warc": """
        with given as (
            select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages
        ), resolved as (
            select page_id, strlen(payload) as n, h, max(page_id) over (partition by h) as winner from given
        )
        select page_id, cast(n as bigint) as payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((cast('0x' || substr(h, 1 + 5 * (i // 4), 5) as bigint) >> (15 - 5 * (i % 4))) & 31), 1)),
                   'string_agg', '') as payload_digest,
               case when page_id = winner then 'response' else 'revisit' end as record_type,
               case when page_id <> winner then winner end as refers_to
        from resolved
    """,
}
