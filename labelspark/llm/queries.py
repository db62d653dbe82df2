"""The registered queries of this subpackage, with SQL where SQL can state them over whole tables."""

from labelspark.llm import (
    bpe_tree,
    contamination,
    exact,
    language_id,
    lookup_clusters,
    mixing,
    near,
    packing,
    prefix_trie,
    quality,
    repeats,
    secrets,
    token_store,
)

QUERIES, ORACLE = {}, {}


def query(name, sql=None):
    def register(build):
        QUERIES[name] = lambda spark, folder: build(spark, lambda table: spark.read.parquet(f"{folder}/{table}.parquet"))
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


@query("op1_mixing")
def op1(spark, read):
    return mixing.score(read("documents"))


@query("op2_repeats")
def op2(spark, read):
    return repeats.remove_repeats(read("documents")).drop("kept")


@query("op3_packing")
def op3(spark, read):
    return packing.pack(read("documents"))


@query("op4_language_id")
def op4(spark, read):
    docs = read("documents")
    return language_id.predict(docs, language_id.train(docs))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op5_near_dedup",
    f"""
    with recursive words as (
      select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'),
                                 lambda w: w <> '') as w
      from documents
    ),
    sets as (
      select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                          else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s
      from words
    ),
    shingles as (select doc_id, unnest(s) as h from sets),
    common as (
      select x.doc_id as a, y.doc_id as b, count(*) as n from shingles x join shingles y using (h) where x.doc_id < y.doc_id group by all
    ),
    links as (
      select a, b from common join sets x on x.doc_id = a join sets y on y.doc_id = b
      where 100 * n >= 85 * (len(x.s) + len(y.s) - n)
    ),
    ways as (select a, b from links union all select b, a from links),
    reached as (
      select doc_id as a, doc_id as b from documents
      union
      select reached.a, ways.b from reached join ways on reached.b = ways.a
    ),
    roots as (select a as doc_id, min(b) as component_id from reached group by a)
    select doc_id, len(s) as n_shingles, component_id, doc_id = component_id as kept from sets join roots using (doc_id)
    """,
)
def op5(spark, read):
    return near.near_duplicates(read("documents"))


@query("op6_secrets")
def op6(spark, read):
    docs = read("documents")
    return secrets.find(docs, secrets.train(docs))


@query("op7_token_files")
def op7(spark, read):
    return token_store.round_trip(read("documents"))


@query(
    "op8_exact_dedup",
    """
    with rows as (select doc_id, coalesce(text, '') as text from documents),
    groups as (select text, max(doc_id) as keep_id, count(*) as group_size from rows group by text)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(text) as text_sha256 from rows join groups using (text)
    """,
)
def op8(spark, read):
    return exact.exact_duplicates(read("documents"))


@query("op9_quality")
def op9(spark, read):
    docs = read("documents")
    return quality.score(docs, quality.train(docs, read("labels")))


def _marked(table, key):
    """The steps of `contamination.marked` and `template_tokens` in SQL: (key, words, template) of a table."""
    c = contamination
    return rf"""
      select {key}, list_filter(regexp_extract_all(m, '[\x01\x02\x03][^\x04]*\x04|[\p{{L}}\p{{Nd}}]+'), lambda x: x <> '') as words,
             list_filter(regexp_extract_all(regexp_replace(m, '([\x01\x02\x03])[^\x04]*\x04', '\1 ', 'g'),
                                            '[\x01\x02\x03]|[\p{{L}}\p{{Nd}}]+'), lambda x: x <> '') as t
      from (
        select {key}, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x01-\x04]', ' ', 'g'),
          '{c.UNIT}', '\1 ' || chr(1) || '\2' || chr(4) || '\3', 'g'),
          '{c.NUMBER}', chr(2) || '\1' || chr(4), 'g'),
          '{c.NAME}', '\1' || chr(3) || '\2' || chr(4), 'g')) as m
        from {table}
      )"""


@query(
    "op10_decontamination",
    f"""
    with docs as ({_marked("documents", "doc_id")}),
    items as ({_marked("benchmark", "item_id")}),
    item_sizes as (select item_id, words, t, len(t) as n_tokens, least(len(t), {contamination.WINDOW}) as size from items where len(t) > 0),
    all_windows as (
      select item_id, size, p - 1 as item_pos, array_to_string(t[p:p + size - 1], ' ') as w
      from (select *, unnest(range(1, n_tokens - size + 2)) as p from item_sizes)
      where len(list_filter(t[p:p + size - 1], lambda x: ascii(x) >= 4)) > 0
    ),
    reach as (select item_id, count(distinct token) as n_tokens from (select item_id, item_pos + unnest(range(0, size)) as token from all_windows) group by item_id),
    item_windows as (select * from all_windows join reach using (item_id)),
    doc_windows as (
      select doc_id, size, p - 1 as doc_pos, array_to_string(t[p:p + size - 1], ' ') as w
      from (select doc_id, t, size, unnest(range(1, len(t) - size + 2)) as p
            from docs cross join (select distinct size from item_sizes))
    ),
    matches as (
      select doc_id, item_id, size, n_tokens, item_pos, doc_pos - item_pos as shift from doc_windows join item_windows using (w, size)
    ),
    covered as (
      select distinct doc_id, item_id, n_tokens, shift, item_pos + unnest(range(0, size)) as token from matches
    ),
    pairs as (
      select c.doc_id, c.item_id, c.shift, i.words[c.token + 1] as asked, d.words[c.token + c.shift + 1] as value
      from covered c join items i using (item_id) join docs d using (doc_id) where ascii(i.words[c.token + 1]) < 4
    ),
    verdict as (
      select doc_id, item_id, shift, bool_and(n = 1) as consistent, bool_and(n = 1 and same) as same
      from (select doc_id, item_id, shift, asked, count(distinct value) as n, bool_and(asked = value) as same from pairs group by all)
      group by all
    ),
    kept as (
      select doc_id, item_id, shift, coalesce(same, true) as same from (select distinct doc_id, item_id, shift from matches)
      left join verdict using (doc_id, item_id, shift) where coalesce(consistent, true)
    ),
    tokens as (
      select doc_id, item_id, n_tokens, token, bool_or(same) as same from covered join kept using (doc_id, item_id, shift) group by all
    ),
    runs as (
      select doc_id, item_id, max(n) as run from (
        select doc_id, item_id, shift, island, count(*) as n
        from (select *, token - row_number() over (partition by doc_id, item_id, shift order by token) as island
              from covered join kept using (doc_id, item_id, shift)) group by all) group by doc_id, item_id
    ),
    totals as (select doc_id, item_id, n_tokens, count(*) as n, bool_and(same) as exact_slots from tokens group by all),
    windows as (
      select doc_id, item_id, count(*) as n_windows
      from (select distinct doc_id, item_id, shift, item_pos from matches) join kept using (doc_id, item_id, shift) group by all
    )
    select doc_id, item_id, n_windows, n / n_tokens as covered, exact_slots from totals join windows using (doc_id, item_id)
    join runs using (doc_id, item_id)
    where n >= {contamination.COVER} * n_tokens or run >= {contamination.RUN}
    """,
)
def op10(spark, read):
    return contamination.leaks(read("documents"), read("benchmark"))


#: The unsigned crc32 of a decimal number's text: a step per character and eight halvings each.
CRC32 = """xor(4294967295, list_reduce(
    [4294967295] || flatten(list_transform(string_split(cast(conv_id as varchar), ''),
                                           lambda x: [cast(ord(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end))"""


@query(
    "op11_prefix_trie",
    rf"""
    with turns as (
      select conv_id, struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) as said,
             row_number() over (partition by conv_id order by turn nulls first, role, text) as p
      from conversations where conv_id is not null
    ),
    convs as (
      select conv_id as c, conv_id - conv_id % 20 as b, {CRC32} % 4 as h, n from (select conv_id, count(*) as n from turns group by conv_id)
    ),
    own as (select x.*, least(h, coalesce(y.n, 0)) as used from convs x left join (select c as b, n from convs) y using (b)),
    rebuilt as (
      select c, p as d, said from own join turns on conv_id = b where p <= used
      union all
      select c, used + p - h, said from own join turns on conv_id = c where p > h
    ),
    whole as (
      select c, coalesce(l, []) as l from convs left join (select c, list(said order by d) as l from rebuilt group by c) using (c)
    ),
    nodes as (
      select key, d, min(c) as conv_id, count(*) as n_convs,
             case when d = 0 then 0 else len(regexp_extract_all(key[d].text, '[^ 	-
]+')) end as words
      from (select c, d, l[1:d] as key from (select c, l, unnest(range(0, len(l) + 1)) as d from whole)) group by key, d
    ),
    children as (select key[1:d - 1] as key, count(*) as n_children from nodes where d > 0 group by all),
    sizes as (select *, coalesce(n_children, 0) as kids from nodes left join children using (key)),
    below as (
      select key[1:a] as key, count(*) filter (where kids = 0) as n_leaves, sum((n_convs - 1) * words) as saved_tokens
      from (select *, unnest(range(0, d + 1)) as a from sizes) group by 1
    ),
    ends as (select l as key, string_agg(cast(c as varchar), ',' order by c) as ids from whole group by l)
    select x.conv_id, cast(x.d as bigint) as depth, p.conv_id as parent_conv_id, x.n_convs, cast(x.kids as bigint) as n_children,
           n_leaves, cast(saved_tokens as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
    from sizes x join below using (key) left join ends using (key)
    left join nodes p on x.d > 0 and p.key = x.key[1:x.d - 1]
    """,
)
def op11(spark, read):
    return prefix_trie.build(read("conversations")).drop("key", "parent")


def _cluster_sql(rounds=10, k=8):
    """Every round as a step of its own: squared distances of all vectors to all centroids, then the means."""
    steps = [
        rf"""vecs as (
      select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v
      from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64
    ),
    cells as materialized (select r, unnest(range(1, 65)) as d, unnest(v) as x from vecs),
    c0 as materialized (
      select cast(row_number() over (order by h, v) - 1 as integer) as c, unnest(range(1, 65)) as d, unnest(v) as m
      from (select v, sha256('3:' || vec_id) as h from vecs order by h, v limit {k})
    )"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""a{n} as materialized (
      select r, c, s from (select r, c, s, row_number() over (partition by r order by s, c) as place
        from (select r, c, sum((x - m) * (x - m)) as s from cells join c{n} using (d) group by r, c)) where place = 1
    )"""
        )
        if n < rounds:
            steps.append(
                f"""c{n + 1} as materialized (
      select c, d, coalesce((t - ((t % n) + n) % n) // n, m) as m from c{n}
      left join (select c, d, sum(x) as t, count(*) as n from cells join a{n} using (r) group by c, d) using (c, d)
    )"""
            )
    return f"""with {", ".join(steps)},
    names as (select c, sha256(string_agg(cast(cast(m as bigint) as varchar), ',' order by d)) as centroid_sha256 from c{rounds} group by c)
    select vec_id, c as cluster, cast(s as bigint) as distance, cast(sum(s) over (partition by c) as bigint) as cluster_inertia,
           cast(sum(s) over () as bigint) as inertia, centroid_sha256
    from a{rounds} join vecs using (r) join names using (c)"""


@query("op12_lookup_clusters", _cluster_sql())
def op12(spark, read):
    return lookup_clusters.cluster(read("embeddings"))[0]


@query("op13_bpe_tree")
def op13(spark, read):
    return bpe_tree.digests(bpe_tree.round_trip(read("documents")))
