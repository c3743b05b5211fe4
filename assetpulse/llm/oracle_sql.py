"""DuckDB SQL of the queries that SQL can express on whole tables."""

_WORDS = ("list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')")


def _shingles(table: str, key: str) -> str:
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: w[i:i+4])
                                       WHEN len(w) > 0 THEN [w] ELSE [] END) AS s
    FROM (SELECT {key}, {_WORDS} AS w FROM {table})"""


def _components(nodes: str, links: str) -> str:
    return f"""
    reach(id, seen) AS (
      SELECT id, id FROM ({nodes})
      UNION
      SELECT r.id, l.b FROM reach r JOIN (SELECT a, b FROM {links} UNION SELECT b, a FROM {links}) l ON l.a = r.seen),
    comp AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id)"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join([*map(_field, ("doc_id", "source", "lang", "n_chars")), _field(text)]) + ")"


#: crc32 of a number's decimal digits: the eight shifts of a byte as a reduction, the bytes as another.
_SHIFTED = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
_DIGITS = "list_transform(string_split(doc_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)"
_CRC = f"xor(list_reduce(list_concat([4294967295::BIGINT], {_DIGITS}), lambda c, b: {_SHIFTED}), 4294967295)"


def _tree(name: str, nodes: str, leaves: str, depth: int) -> str:
    """Levels of the trees over ``nodes(g, pos, h, m)`` and the climb of ``leaves(g, pos, acc, proof, ...)``; ``m`` counts a tree's nodes."""
    join = lambda x: f"coalesce(array_to_string({x}, ''), '')"
    left, right = join("r.hs[1:c.pos % 16]"), join("r.hs[c.pos % 16 + 2:]")
    out = [f"{name}0 AS (SELECT g, pos, h, m FROM {nodes})", f"{name}c0 AS (SELECT * FROM {leaves})"]
    for k in range(depth):
        out += [f"{name}r{k} AS (SELECT g, pos // 16 AS pos, list(h ORDER BY pos) AS hs, max(m) AS m FROM {name}{k} GROUP BY ALL)",
                f"{name}{k + 1} AS (SELECT g, pos, CASE WHEN m = 1 THEN hs[1] ELSE sha256({join('hs')}) END AS h, (m + 15) // 16 AS m FROM {name}r{k})",
                f"""{name}c{k + 1} AS (SELECT c.* REPLACE (c.pos // 16 AS pos,
                  CASE WHEN r.m = 1 THEN c.acc ELSE sha256({left} || c.acc || {right}) END AS acc,
                  CASE WHEN r.m = 1 THEN c.proof ELSE c.proof || {left} || {right} END AS proof)
                  FROM {name}c{k} c JOIN {name}r{k} r ON r.g = c.g AND r.pos = c.pos // 16)"""]
    return ",\n".join(out)


_TERMS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")

SQL = {
    "op3_chat_formatting": """
    WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position,
                      coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY position) AS l FROM t GROUP BY conv_id),
    keep AS (SELECT conv_id, n_turns FROM c a WHERE NOT EXISTS (
      SELECT 1 FROM c b WHERE b.conv_id <> a.conv_id AND b.l[1:a.n_turns] = a.l AND (b.n_turns > a.n_turns OR b.conv_id < a.conv_id)))
    SELECT t.conv_id, k.n_turns, t.position, t.role,
           '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10) AS rendered
    FROM t JOIN keep k ON t.conv_id = k.conv_id""",
    "op4_warc": """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, html, max(page_id) OVER (PARTITION BY html) AS last FROM p),
    b AS (SELECT *, list_aggregate(list_transform(string_split(sha1(html), ''),
             lambda c: substr('0000000100100011010001010110011110001001101010111100110111101111', strpos('0123456789abcdef', c) * 4 - 3, 4)),
             'string_agg', '') AS bits FROM d)
    SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
           list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             (16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
              + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
           CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> last THEN last END AS refers_to
    FROM b""",
    "op7_vector_dedup": f"""
    WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    ok AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(v, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id < b.vec_id
              AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
    {_components("SELECT vec_id AS id FROM e", "links")},
    n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
    SELECT c.id AS vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.id = c.component_id AS kept
    FROM comp c LEFT JOIN n ON n.id = c.id""",
    "op8_minhash_near_dedup": f"""
    WITH RECURSIVE sh AS ({_shingles("documents", "doc_id")}),
    n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    {_components("SELECT doc_id AS id FROM documents", "links")}
    SELECT c.id AS doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.id = c.component_id AS kept
    FROM comp c LEFT JOIN n ON n.doc_id = c.id""",
    "op9_decontamination": f"""
    WITH d AS ({_shingles("documents", "doc_id")}), i AS ({_shingles("benchmark", "item_id")}),
    n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
    SELECT d.doc_id, i.item_id, n.n::BIGINT AS item_shingles, count(*)::BIGINT AS shared
    FROM d JOIN i ON d.s = i.s JOIN n ON n.item_id = i.item_id
    GROUP BY d.doc_id, i.item_id, n.n HAVING 100 * count(*) >= 75 * n.n""",
    "op11_merkle_manifest": f"""
    WITH l AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, {_leaf("text")} AS leaf,
                 CASE WHEN {_CRC} % 5 = 0 THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS changed
               FROM documents),
    p AS (SELECT doc_id, g, leaf, coalesce(changed, leaf) AS changed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
            count(*) OVER (PARTITION BY g) AS m FROM l),
    {_tree("s", "(SELECT g, pos, leaf AS h, m FROM p)", "(SELECT doc_id, leaf, g, pos, changed AS acc, '' AS proof FROM p)", 6)},
    {_tree("u", "(SELECT 0 AS g, g AS pos, h, (SELECT count(*) FROM s6) AS m FROM s6)",
           "(SELECT c.doc_id, c.leaf, s6.h AS subroot, 0 AS g, c.g AS pos, c.acc, c.proof FROM sc6 c JOIN s6 ON s6.g = c.g)", 4)}
    SELECT doc_id, leaf, subroot, u4.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = u4.h AS verified
    FROM uc4 JOIN u4 ON true""",
    "op13_ranked_search": f"""
    WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS} AS w FROM documents),
    tf AS (SELECT r, doc_id, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, unnest(w) AS term FROM d) GROUP BY ALL),
    n AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
    st AS (SELECT count(*)::BIGINT AS nn, sum(n)::BIGINT AS ll FROM n),
    df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
    w AS (SELECT term, floor(1000 * ln(((2 * nn + 2)::DOUBLE) / (2 * df + 1)))::BIGINT AS w FROM df, st),
    i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
    s AS (SELECT i.item_id, tf.r, tf.doc_id,
            sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + ((90 * n.n * st.nn) // st.ll)))))::BIGINT AS score
          FROM i JOIN tf ON tf.term = i.term JOIN w ON w.term = i.term JOIN n ON n.r = tf.r, st GROUP BY ALL),
    k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score FROM s WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM k WHERE rank <= 10""",
}
