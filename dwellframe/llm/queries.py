"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from dwellframe.llm import alignment, idfiles, lines, links, mixing, neardup, packing, privacy, quality, search, separators, sketches, variants
from dwellframe.llm.common import table

URL_RULES = (
    links.Rule("allow", "com", "/"), links.Rule("block", "example.com", "/en/"),
    links.Rule("allow", "www.example.com", "/en/"), links.Rule("block", "net", "/es/"), links.Rule("block", "net", "/fr/"),
)


END_OF_TEXT = 50256  # of byte_bpe_50k


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """The path of an installed public tokenizer file; every executor has the package."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark, sf_dir):
    """Each document's class of copies, linked group and number of verified links."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    members, _ = neardup.jaccard_join(docs, width=5, threshold=0.8, recall=0.999)
    return members.select("doc_id", "copy_id", "class_id", "n_links")


def op2_source_mix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    taken = mixing.mix(docs, weights=(1, 2, 3), max_epochs=3, carry=["doc_id"])
    return taken.select("doc_id", F.col("m_size").alias("size"), "source_size", "target",
                        (F.col("m_size") * F.col("repeats")).alias("taken"))


def op3_line_alignment(spark, sf_dir):
    """Every document with its cleaned text and the deleted line ranges."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = lines.dedup_lines(docs, min_words=50)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return cleaned.select("doc_id", "text", "spans", removed.alias("n_removed_lines"))


def op4_link_graph_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return links.judge_pages(pages, URL_RULES, carry=["page_id"]).select("page_id", "host", "path", "rule", "verdict")


def op5_host_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.judge(docs, carry=["doc_id"])


def op7_surrogates(spark, sf_dir):
    """Every document with surrogates for its personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return privacy.replace_entities(docs, key="surrogate-key-1")


def op8_permutation_index(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.nearest(vectors, F.col("vec_id") % 50 == 0, k=5)


def op9_genetic_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, tokenizer_file(), carry=["doc_id"], end_id=0, capacity=2048)


def op6_separator_scan(spark, sf_dir):
    """Token count and place of every document, found in flat files written from all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = separators.write_flat(docs, tokenizer_file(), end_id=END_OF_TEXT)
    counted = separators.count_tokens(order.select("file"), END_OF_TEXT, id_width=2)
    return counted.join(order, ["file", "ordinal"]).select("doc_id", "ordinal", "start", "n_tokens", "closed")


def op10_range_coder(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return idfiles.read_ids(spark, idfiles.write_ids(docs, tokenizer_file(), end_id=2))


def op11_letter_grams(spark, sf_dir):
    """Every word's commonest spelling and its root."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return variants.group_variants(variants.count_words(docs, shortest=7, least=2, noise=31), ratio=10)


def op12_identity_map(spark, sf_dir):
    """Links between the ids of two tokenizers, per document and with corpus-wide counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    aligned, _ = alignment.align(docs, tokenizer_file(), tokenizer_file("piece_bpe_32k.model"), digest=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")


def op13_bottom_k(spark, sf_dir):
    """Every document's fingerprint, that of its edited text, and both likenesses."""
    return sketches.compare_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))


_W = r"[^\x20\x09-\x0D]+"

OP2_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_W}')) AS BIGINT) AS size,
         md5(concat('mix|', coalesce(CAST(doc_id AS VARCHAR), ''), '|', md5(coalesce(text, '')))) AS k
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(ss) OVER () AS total, sum(w) OVER () AS all_w, row_number() OVER (ORDER BY 3 * ss / w, source) AS pos,
         coalesce(sum(3 * ss) OVER (ORDER BY 3 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         coalesce(sum(w) OVER (ORDER BY 3 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
  FROM s),
l AS (SELECT min(pos) AS pos FROM o WHERE 3 * ss * (all_w - ws) >= (total - caps) * w),
v AS (SELECT o.total - o.caps AS remaining, o.all_w - o.ws AS weight FROM o JOIN l USING (pos)),
t AS (
  SELECT source, CAST(ss AS BIGINT) AS source_size,
         CASE WHEN ss = 0 THEN 0.0 ELSE least(3 * ss, remaining * w / weight) END AS target
  FROM o, v),
n AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
g AS (
  SELECT d.source, k, sum(size) AS g FROM d GROUP BY d.source, k),
c AS (
  SELECT g.source, k, target - whole * source_size AS need, g,
         sum(g) OVER (PARTITION BY g.source ORDER BY k ROWS UNBOUNDED PRECEDING) AS after
  FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source),
e AS (SELECT source, k FROM c WHERE need > 0 AND after - g < need AND after - need <= need - (after - g))
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN e.k IS NULL THEN 0 ELSE 1 END) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
LEFT JOIN e ON e.source IS NOT DISTINCT FROM d.source AND e.k = d.k
"""


def _op4_sql(rounds: int = 12, damping: float = 0.85) -> str:
    rules = ", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in URL_RULES)
    sql = rf"""
WITH RECURSIVE r(rule, rule_host, rule_path, verdict) AS (VALUES {rules}),
u AS (
  SELECT page_id, coalesce(html, '') AS html,
         CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{links.UPPER}', '{links.LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS row_no FROM u),
f AS (
  SELECT h.row_no, max_by(struct_pack(rule := rule, verdict := verdict), length(rule)) AS fit
  FROM h JOIN r ON (host = rule_host OR host LIKE '%.' || rule_host) AND starts_with(path, rule_path) GROUP BY h.row_no),
j AS MATERIALIZED (SELECT h.*, fit.rule AS rule, fit.verdict AS verdict FROM h LEFT JOIN f USING (row_no)),
seeds AS (
  SELECT host, avg(CASE WHEN verdict = 'allow' THEN 1.0 ELSE 0.0 END) AS a,
         avg(CASE WHEN verdict = 'block' THEN 1.0 ELSE 0.0 END) AS b FROM j WHERE host <> '' GROUP BY host),
e0 AS (
  SELECT host AS src, translate(dst, '{links.UPPER}', '{links.LOWER}') AS dst
  FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:https?:)?//([^/?#"''\s<>]+)', 1)) AS dst FROM j)),
e AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM e0 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)"""
    for side, seed, src, dst, part in (("t", "a", "src", "dst", "* (1 - coalesce(b, 0))"), ("d", "b", "dst", "src", "")):
        sql += f""",
{side}n AS MATERIALIZED (
  SELECT host, sum(seed) AS seed, max(o) AS o FROM (
    SELECT host, {seed} AS seed, 0 AS o FROM seeds UNION ALL SELECT {src}, 0.0, 1 FROM e UNION ALL SELECT {dst}, 0.0, 0 FROM e)
  GROUP BY host),
{side}s AS MATERIALIZED (
  SELECT {src} AS src, {dst} AS dst, weight / sum(weight) OVER (PARTITION BY {src}) {part} AS part FROM e LEFT JOIN seeds ON host = dst
  UNION ALL SELECT host, host, 1.0 FROM {side}n WHERE o = 0),
{side}0 AS MATERIALIZED (SELECT host, seed AS score FROM {side}n)"""
        for i in range(rounds):
            sql += f""",
{side}{i + 1} AS MATERIALIZED (
  SELECT n.host, {1 - damping} * n.seed + {damping} * coalesce(sum(p.score * s.part), 0) AS score
  FROM {side}n n LEFT JOIN {side}s s ON s.dst = n.host LEFT JOIN {side}{i} p ON p.host = s.src GROUP BY n.host, n.seed)"""
    return sql + f"""
SELECT page_id, j.host, path, rule,
       coalesce(verdict, CASE WHEN d.score >= 0.5 AND d.score > t.score THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t{rounds} t ON t.host = j.host LEFT JOIN d{rounds} d ON d.host = j.host
"""


def quality_sql(select: str, source: str = "documents") -> str:
    """Document measures and host verdicts in SQL; ``select`` reads ``judged``."""
    rules = {"short": "n_words < 20", "repeated": "100 * n_repeat_words > 30 * n_words", "symbols": "10 * n_symbols > n_words",
             "dup_lines": "20 * n_dup_lines > n_words", "word_length": "(word_chars < 3 * n_words OR word_chars > 12 * n_words)"}
    fails = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS {r}" for r, c in rules.items())
    priors = ", ".join(
        f"sum({r}) / sum(n) AS m_{r}, sum({r} * {r} / n) / sum(n) - (sum({r}) / sum(n)) * (sum({r}) / sum(n)) "
        f"- (sum({r}) / sum(n)) * (1 - sum({r}) / sum(n)) * count(*) / sum(n) AS b_{r}" for r in rules)
    strengths = ", ".join(
        f"m_{r}, CASE WHEN m_{r} * (1 - m_{r}) > 0 AND b_{r} > 0 "
        f"THEN least(greatest(m_{r} * (1 - m_{r}) / b_{r} - 1, 1.0), 1e6) ELSE 1e6 END AS s_{r}" for r in rules)
    bad = " OR ".join(f"({r} + m_{r} * s_{r}) / (n + s_{r}) > 0.5" for r in rules)
    return rf"""
WITH rows AS (SELECT *, row_number() OVER () AS row_no, coalesce(text, '') AS body FROM {source}),
word_lists AS (SELECT row_no, regexp_extract_all(body, '{_W}') AS w FROM rows),
grams AS (
  SELECT row_no, unnest(range(1, len(w) - 6)) AS i, w FROM word_lists WHERE len(w) >= 8),
windows AS (SELECT row_no, i, array_to_string(w[i:i + 7], ' ') AS g FROM grams),
twice AS (SELECT row_no, i FROM (SELECT *, count(*) OVER (PARTITION BY row_no, g) AS c FROM windows) WHERE c > 1),
marked AS (
  SELECT row_no, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY row_no),
lines AS (
  SELECT row_no, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT row_no, unnest(string_split(body, chr(10))) AS line FROM rows) WHERE regexp_matches(line, '{_W}') GROUP BY row_no),
measured AS (
  SELECT rows.*, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM rows JOIN word_lists USING (row_no) LEFT JOIN marked USING (row_no) LEFT JOIN lines USING (row_no)),
hosts AS (SELECT source AS host, CAST(count(*) AS DOUBLE) AS n, {fails} FROM measured WHERE source IS NOT NULL GROUP BY source),
spread AS (SELECT {priors} FROM hosts),
prior AS (SELECT {strengths} FROM spread),
bad_hosts AS (SELECT host FROM hosts, prior WHERE {bad}),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured),
judged AS (
  SELECT *, NOT base_failed AND coalesce(source NOT IN (SELECT host FROM bad_hosts), true) AS kept FROM based)
{select}
"""


OP5_SQL = quality_sql("SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged")

OP11_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, '{variants.UPPER}', '{variants.LOWER}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[{variants.LETTERS}]{{7,}}')) AS run FROM documents)),
hexed AS (
  SELECT run, count(*) AS c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs GROUP BY doc_id, run),
crcs AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, len(x), 2),
    lambda i: [('0x' || substr(x, i, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda h, b: xor(xor(h, b) // 2, (xor(h, b) % 2) * 3988292384)), 4294967295) AS h FROM hexed),
cut AS (
  SELECT c, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crcs),
words AS MATERIALIZED (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words),
rests AS MATERIALIZED (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT r.word, w.word, w.n FROM rests r JOIN words w ON w.word = r.rest
  UNION SELECT w.word, r.word, r.n FROM rests r JOIN words w ON w.word = r.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM near GROUP BY word),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
         CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
roots AS (
  SELECT word, word AS root FROM forms WHERE form IS NULL
  UNION ALL SELECT forms.word, root FROM forms JOIN roots ON forms.form = roots.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def _op13_sql(k: int = sketches.SIZE) -> str:
    top = 2 ** 64
    terms = " + ".join(f"CASE WHEN i + {j} <= len(w) THEN (w[i + {j}]::HUGEINT * {f}) % {top} ELSE 0 END"
                       for j, f in enumerate(sketches.FACTORS))
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         row_number() OVER (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, ''))) AS r, count(*) OVER () AS c FROM documents),
e AS (
  SELECT a.r, b.r AS next_r, a.doc_id, a.t, length(a.t) AS n_chars,
         left(a.t, length(a.t) - length(a.t) // 2) || left(b.t, length(a.t) // 2) AS edited
  FROM d a JOIN d b ON b.r = a.r % a.c + 1),
x AS (SELECT r, 0 AS side, t FROM e UNION ALL SELECT r, 1, edited FROM e),
l AS (SELECT r, side, list_transform(regexp_extract_all(t, '{_W}'), lambda z: md5_number_lower(z)) AS w FROM x),
g AS (SELECT r, side, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM l WHERE len(w) > 0),
h AS (SELECT r, side, ((least(5, len(w)) * {sketches.LENGTH_FACTOR}::HUGEINT + {terms}) % {top})::UBIGINT AS s FROM g),
m AS (SELECT r, side, ((xor(s, s >> 32)::HUGEINT * {sketches.MIX}) % {top})::UBIGINT AS s FROM h),
q AS (SELECT DISTINCT r, side, xor(s, s >> 29) AS s FROM m),
k AS (SELECT *, row_number() OVER (PARTITION BY r, side ORDER BY s) AS pos FROM q),
f AS (
  SELECT x.r, x.side, coalesce(list(s ORDER BY s) FILTER (s IS NOT NULL), []) AS s
  FROM x LEFT JOIN (SELECT * FROM k WHERE pos <= {k}) k ON k.r = x.r AND k.side = x.side GROUP BY x.r, x.side),
p AS (
  SELECT e.*, a.s AS a, b.s AS b, list_sort(list_distinct(a.s || b.s))[1:{k}] AS ab, n.s AS n,
         list_sort(list_distinct(a.s || n.s))[1:{k}] AS an
  FROM e JOIN f a ON a.r = e.r AND a.side = 0 JOIN f b ON b.r = e.r AND b.side = 1 JOIN f n ON n.r = next_r AND n.side = 0)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
       array_to_string(list_transform(a, lambda z: lpad(lower(to_hex(z)), 16, '0')), '') AS fingerprint,
       array_to_string(list_transform(b, lambda z: lpad(lower(to_hex(z)), 16, '0')), '') AS edited_fingerprint,
       CASE WHEN len(ab) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(ab, a), b)) / len(ab) END::DOUBLE AS near_edited,
       CASE WHEN len(an) = 0 THEN 1.0 ELSE len(list_intersect(list_intersect(an, a), n)) / len(an) END::DOUBLE AS near_next
FROM p
"""


QUERIES = {
    "op6_separator_scan": (op6_separator_scan, None),
    "op10_range_coder": (op10_range_coder, None),
    "op1_ngram_jaccard": (op1_ngram_jaccard, None),
    "op3_line_alignment": (op3_line_alignment, None),
    "op7_surrogates": (op7_surrogates, None),
    "op8_permutation_index": (op8_permutation_index, None),
    "op9_genetic_packing": (op9_genetic_packing, None),
    "op2_source_mix": (op2_source_mix, OP2_SQL),
    "op4_link_graph_filter": (op4_link_graph_filter, _op4_sql()),
    "op5_host_quality": (op5_host_quality, OP5_SQL),
    "op11_letter_grams": (op11_letter_grams, OP11_SQL),
    "op12_identity_map": (op12_identity_map, None),
    "op13_bottom_k": (op13_bottom_k, _op13_sql()),
}
