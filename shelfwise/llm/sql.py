"""DuckDB twins of the training-data queries that SQL can express, over the same whole tables."""

ORACLE: dict[str, str] = {}

# SHA-1 in base32: each five hexadecimal digits are twenty bits, that is four base32 digits.
ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(encode(coalesce(html, ''))) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first_id FROM p GROUP BY h),
d AS (SELECT h, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * CAST(k // 4 AS INTEGER) + 1, 5))::BIGINT
      >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31)::INTEGER, 1), '' ORDER BY k) AS digest
      FROM (SELECT DISTINCT h FROM p), range(32) AS r(k) GROUP BY h)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM first_id OR first_id IS NULL THEN NULL ELSE first_id END AS refers_to
FROM p JOIN f USING (h) JOIN d USING (h)
"""

ORACLE["op4_quality"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w WHERE len(w) > 2)),
rep AS (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
nrep AS (SELECT r, count(DISTINCT p) AS n FROM rep GROUP BY r),
l AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT x) AS dups
      FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
             coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lines, 0) AS n_lines,
             length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^0-9]', '', 'g')) AS n_digits
      FROM w LEFT JOIN nrep USING (r) LEFT JOIN l USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 10 * n_upper > 4 * word_chars
            OR 10 * n_digits > 4 * word_chars OR 2 * word_chars < 5 * n_words OR word_chars > 15 * n_words
            OR 2 * n_dup_lines > n_lines) AS kept
FROM f
"""


def _merkle(levels: int) -> str:
    """Level tables of eight-fold trees: a group's rows become their parents while it has more than one."""
    def tree(name: str, leaves: str) -> str:
        parts = [f"{name}0 AS ({leaves})"]
        for k in range(levels):
            parts.append(f"""{name}p{k} AS (SELECT g, i // 8 AS i, n, CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
  FROM {name}{k} GROUP BY g, i // 8, n)""")
            parts.append(f"{name}{k + 1} AS (SELECT g, i, count(*) OVER (PARTITION BY g) AS n, h FROM {name}p{k})")
        return ",\n".join(parts)

    def sides(name: str, row: str) -> str:
        """Left and right siblings of every node of every level."""
        return ",\n".join(f"""{name}s{k} AS (SELECT g, i, n,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
  CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
  FROM {name}{k} WINDOW w AS (PARTITION BY g, i // 8 ORDER BY i))""" for k in range(levels))

    folds, last = [], "f0"
    for name, key, at in (("a", "g", "i"), ("b", "''", "j")):
        for k in range(levels):
            step = 8 ** k
            new = f"{name}f{k}"
            folds.append(f"""{new} AS (SELECT f.* EXCLUDE (h, proof), CASE WHEN s.n > 1 THEN sha256(s.l || f.h || s.r) ELSE f.h END AS h, f.proof || s.l || s.r AS proof
  FROM {last} f JOIN {name}s{k} s ON s.g = {'f.g' if name == 'a' else key} AND s.i = f.{at} // {step})""")
            last = new
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    return f"""
WITH table256 AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY b) AS t FROM range(256) r(b)),
d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
      xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM documents, table256),
leaves AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf,
           CASE WHEN crc % 3 = 0 AND text IS NOT NULL THEN {leaf('lower_text')} END AS changed FROM d),
ranked AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
{tree('a', 'SELECT g, i, n, leaf AS h FROM ranked')},
subroots AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS n FROM a{levels}),
{tree('b', "SELECT '' AS g, j AS i, n, subroot AS h FROM subroots")},
{sides('a', 'i')},
{sides('b', 'j')},
f0 AS (SELECT r.doc_id, r.leaf, r.g, r.i, s.j, s.subroot, coalesce(r.changed, r.leaf) AS h, '' AS proof FROM ranked r JOIN subroots s USING (g)),
{", ".join(folds)}
SELECT f.doc_id, f.leaf, f.subroot, b.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = b.h AS verified
FROM {last} f, b{levels} b
"""


ORACLE["op13_merkle"] = _merkle(8)

ORACLE["op12_repeated_passages"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
w AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS p, len(w) AS n FROM d),
s AS (SELECT *, CASE WHEN p + 20 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS s FROM w),
f AS (SELECT *, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1 AS again FROM s),
c AS (SELECT *, coalesce(max(CASE WHEN again THEN p END) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), -1) >= 0 AS gone FROM f),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""
