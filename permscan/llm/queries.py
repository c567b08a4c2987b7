"""One query per operator on the benchmark's tables."""

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import new_path
from . import ann, bpe, licenses, mixing, mtree, pages, quality, simhash, spelling, suffix, trie, unigram, warc

PIECES = "piece_bpe_32k.model"
TOKENIZER = "word_bpe_49k.json"


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_simhash(spark, sf):
    found = simhash.near_duplicates(_table(spark, sf, "documents"), shingle=3, most=3)
    return found.withColumn("fingerprint", simhash.fingerprint_hex("fingerprint"))


def op2_mixing(spark, sf):
    mixed = mixing.mix(_table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def digests(decoded: DataFrame, *more: str) -> DataFrame:
    ids = F.col("ids")
    return decoded.select(
        "doc_id",
        *more,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark, sf):
    path = public_tokenizers.path(TOKENIZER)
    return digests(bpe.encode_and_decode(_table(spark, sf, "documents"), path))


def op4_warc(spark, sf):
    files = warc.write(_table(spark, sf, "pages"), new_path(spark, "warc"), least_bytes=0)
    return warc.read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_quality(spark, sf):
    judged = quality.weak_quality(_table(spark, sf, "documents"))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


def op6_licenses(spark, sf):
    found = licenses.scan(_table(spark, sf, "documents"))
    best = F.get("matches", F.lit(0))
    return found.select(
        "doc_id",
        best["license"].alias("license"),
        F.round(best["score"], 6).alias("score"),
        best["line"].alias("line"),
        F.size("matches").cast("long").alias("n_matches"),
    )


def op7_ann(spark, sf):
    return ann.search(_table(spark, sf, "embeddings"), "id % 20 = 0", k=20)


def op8_suffix(spark, sf):
    found = suffix.repeated_passages(_table(spark, sf, "documents"), length=50)
    width = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        width.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_unigram(spark, sf):
    return unigram.count_tokens(_table(spark, sf, "documents"), public_tokenizers.path(PIECES))


def op10_pages(spark, sf):
    found = pages.extract(_table(spark, sf, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op11_trie(spark, sf):
    return trie.prefix_trie(_table(spark, sf, "conversations"), family=20, most=4)


def op12_spelling(spark, sf):
    return spelling.variants(_table(spark, sf, "documents"), least_length=6, least_count=5, factor=5, spoil=199)


def op13_mtree(spark, sf):
    return mtree.search(_table(spark, sf, "embeddings"), "id % 20 = 0", k=20, scale=64)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_bpe": op3_bpe,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_licenses": op6_licenses,
    "op7_ann": op7_ann,
    "op8_suffix": op8_suffix,
    "op9_unigram": op9_unigram,
    "op10_pages": op10_pages,
    "op11_trie": op11_trie,
    "op12_spelling": op12_spelling,
    "op13_mtree": op13_mtree,
}


def _license_sql() -> str:
    rows = []
    for name, texts in licenses.TEMPLATES.items():
        for text in texts:
            grams = licenses.bigrams(text)
            low, high = licenses.size_bounds(len(grams))
            quoted = ", ".join("'" + g.replace("'", "''") + "'" for g in grams)
            rows.append(f"('{name}', {low}, {high}, [{quoted}])")
    return r"""
        with templates(license, low, high, grams) as (values {rows}),
        lined as (select doc_id, string_split(lower(coalesce(text, '')), chr(10)) as lines from documents),
        units as (
            select doc_id, unnest(range(1, len(lines) + 1)) as line, unnest(lines) as body from lined
            union all
            select doc_id, 0, array_to_string(lines, chr(10)) from lined where len(lines) > 1),
        worded as (
            select doc_id, line,
                   list_transform(regexp_extract_all(body, '\.*[a-z0-9][a-z0-9.]*'), lambda w: rtrim(w, '.')) as words
            from units),
        paired as (
            select doc_id, line, len(words) - 1 as size,
                   list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as grams
            from worded where len(words) > 1),
        scored as (
            select p.doc_id, p.line, t.license,
                   max(len(list_intersect(p.grams, t.grams)) * 2.0::double / (p.size + len(t.grams))) as score
            from paired p join templates t on p.size between t.low and t.high
            group by p.doc_id, p.line, t.license),
        ranked as (
            select *, row_number() over (partition by doc_id order by score desc, line, license) as place,
                   count(*) over (partition by doc_id) as n
            from scored where score >= 0.8)
        select d.doc_id, r.license, round(r.score, 6) as score, r.line::int as line, coalesce(r.n, 0)::bigint as n_matches
        from documents d left join ranked r on r.doc_id = d.doc_id and r.place = 1
    """.replace("{rows}", ", ".join(rows))


def _crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes, bit by bit."""
    octets = f"list_transform(range(1, len(hex(encode({text}))), 2), lambda i: ('0x' || substr(hex(encode({text})), i, 2))::bigint)"
    octet = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: {octet}), 4294967295)"


ORACLE = {
    "op2_mixing": r"""
        with sized as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
                   md5(concat(coalesce(cast(doc_id as varchar), ''), ':42')) as draw
            from documents),
        sources as (select source, sum(size)::bigint as source_size from sized group by source),
        weighed as (
            select *, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight
            from sources),
        ranked as (
            select *, sum(source_size) over () * 1.0::double as budget,
                   coalesce(sum(3 * source_size) over before, 0) as dry,
                   sum(weight) over () - coalesce(sum(weight) over before, 0) as open
            from weighed
            window before as (order by 3 * source_size / weight, source nulls last
                              rows between unbounded preceding and 1 preceding)),
        timed as (
            select *, max(case when (budget - dry) / open <= 3 * source_size / weight then (budget - dry) / open end)
                      over () as t
            from ranked),
        shares as (
            select source, source_size, coalesce(least(weight * t, 3.0::double * source_size),
                                                 3.0::double * source_size) as target
            from timed),
        numbered as (select *, row_number() over (order by source nulls last) as number from weighed),
        queue as (
            select row_number() over () as rid, s.doc_id, s.size, h.source_size, h.target, n.weight, n.number,
                   sum(s.size) over (partition by n.number order by draw, doc_id, size
                                     rows between unbounded preceding and current row) - s.size as start
            from sized s join shares h on s.source is not distinct from h.source
            join numbered n on s.source is not distinct from n.source),
        grain as (select greatest(1, ceil(sum(size) / 20000.0))::bigint as piece, sum(size) as budget from sized),
        passes as (select q.*, piece, unnest([0, 1, 2]) as nth from queue q cross join grain),
        places as (select *, unnest(range(0, ((size + piece - 1) // piece)::bigint)) as i from passes),
        pieces as (
            select rid, number, least(size, (i + 1) * piece) - i * piece as words,
                   nth * source_size + start + least(size, (i + 1) * piece) as upto, weight from places),
        served as (
            select rid, words, sum(words) over (order by upto::double / weight, number, upto
                                                rows between unbounded preceding and current row) as upto
            from pieces),
        taken as (
            select rid, sum(greatest(0, least(words, budget - (upto - words)))) as taken from served cross join grain group by rid)
        select doc_id, size::bigint as size, source_size, target, coalesce(taken, 0)::bigint as taken
        from queue left join taken using (rid)
    """,
    "op6_licenses": _license_sql(),
    "op11_trie": r"""
        with turns as (
            select conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} as said, turn
            from conversations where conv_id is not null),
        owned as (
            select conv_id, list(said order by turn nulls first, said) as own, {crc} % 4 as h from turns group by conv_id),
        paths as (
            select c.conv_id, list_concat(coalesce(d.own, [])[1:c.h], c.own[c.h + 1:]) as path
            from owned c left join owned d on d.conv_id = c.conv_id - c.conv_id % 20),
        steps as (select conv_id, path, unnest(range(0, len(path) + 1)) as depth from paths),
        nodes as (
            select path[1:depth] as node, depth, min(conv_id) as conv_id, count(*) as n_convs,
                   string_agg(conv_id::varchar, ',' order by conv_id) filter (where len(path) = depth) as ends
            from steps group by 1, 2),
        children as (select node[1:depth - 1] as node, count(*) as n from nodes where depth > 0 group by 1),
        counted as (
            select n.*, coalesce(c.n, 0) as n_children, case when depth = 0 then 0 else
                   (n_convs - 1) * len(regexp_extract_all(n.node[depth].text, '[^\x20\x09-\x0D]+')) end as saved
            from nodes n left join children c on c.node = n.node and n.depth = len(c.node)),
        upward as (select node, depth, unnest(range(0, depth + 1)) as above, n_children, saved from counted),
        sums as (
            select node[1:above] as node, count(*) filter (where n_children = 0) as leaves, sum(saved) as saved
            from upward group by 1)
        select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.leaves as n_leaves,
               s.saved::bigint as saved_tokens, sha256(coalesce(c.ends, '')) as ends_sha256
        from counted c join sums s on s.node = c.node
        left join nodes p on c.depth > 0 and p.depth = c.depth - 1 and p.node = c.node[1:c.depth - 1]
    """.replace("{crc}", _crc32_sql("conv_id::varchar")),
    "op12_spelling": r"""
        with recursive runs as (
            select coalesce(doc_id::varchar, '') as id,
                   unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')) as run
            from documents),
        lowered as (
            select id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as n
            from runs where length(run) >= 6 group by 1, 2),
        hashed as (select run, n, {crc} as h from lowered),
        words as (
            select case when h % 199 = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
                        else run end as word, sum(n)::bigint as n
            from hashed group by 1 having length(word) >= 6 and sum(n) >= 5),
        dropped as (
            select word, n, i, left(word, i::int) || substr(word, i::int + 2) as form
            from (select word, n, unnest(range(0, length(word))) as i from words)),
        pairs as (
            select a.word, b.word as near, b.n as m from dropped a join dropped b
            on a.i = b.i and a.form = b.form and a.word <> b.word
            union
            select d.word, w.word, w.n from dropped d join words w on w.word = d.form
            union
            select w.word, d.word, d.n from dropped d join words w on w.word = d.form),
        met as (
            select word, count(*) as n_near, max(m) as m, arg_min(near, (-m, near)) as near from pairs group by word),
        judged as (
            select w.word, w.n, coalesce(p.n_near, 0) as n_near, case when p.m >= 5 * w.n then p.near end as form,
                   case when p.m >= 5 * w.n then p.m end as form_n
            from words w left join met p on p.word = w.word),
        followed as (
            select word, word as at, form as next from judged
            union all
            select f.word, j.word, j.form from followed f join judged j on j.word = f.next)
        select j.word, j.form, f.at as root, j.n, j.n_near, j.form_n
        from judged j join followed f on f.word = j.word and f.next is null
    """.replace("{crc}", _crc32_sql("id || ':' || run")),
    "op13_mtree": r"""
        with whole as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
            where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        scored as (
            select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
            from whole q join whole c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
        ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
        select query_id, rank, vec_id, score from ranked where rank <= 20
    """,
}
