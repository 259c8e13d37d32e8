"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM dw CROSS JOIN sizes, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


def _unescape(x: str) -> str:
    """The character references that the page table holds, the ampersand last."""
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("amp", "&")):
        x = f"regexp_replace({x}, '&{name};?', '{char}', 'g')"
    return x


def _uuid(x: str) -> str:
    return f"'<urn:uuid:' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-' || substr({x}, 13, 4) || '-' || substr({x}, 17, 4) || '-' || substr({x}, 21, 12) || '>'"


def _squeezed(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


_GONE = "h"
for _pattern in ("<!--.*?(-->|\\z)", *(f"<{x}\\b[^>]*>.*?(</{x}\\s*>|\\z)" for x in ("script", "style", "template", "noscript"))):
    _GONE = f"regexp_replace({_GONE}, '{_pattern}', '', 'gsi')"
_QUOTED = r"""(?:"[^"]*"|''[^'']*''|[^''">])*>"""
_BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|li|main|nav|ol|option|p|pre|section|table|td|tfoot|th|thead|title|tr|ul"
_BROKEN = f"regexp_replace(regexp_replace(replace(gone, chr(10), ' '), '[^\\S\\n]+', ' ', 'g'), '</?({_BLOCKS})([\\s/]{_QUOTED}|>)', chr(10), 'gi')"
_TEXT = _unescape(f"regexp_replace({_BROKEN}, '<[/!?]?[a-zA-Z]{_QUOTED}|<![^>]*>', '', 'g')")
_TEXT = f"regexp_replace(regexp_replace({_TEXT}, '[^\\S\\n]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g')"

WARC = f"""
WITH pages AS (SELECT page_id, url, coalesce(html, '') AS h, chr(13) || chr(10) AS nl FROM pages),
source AS (
  SELECT page_id, url, h, nl, {_GONE} AS gone, md5('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS m,
    CAST(strlen(h) AS VARCHAR) AS n, 'text/html; charset=utf-8' AS kind
  FROM pages),
named AS (
  SELECT *, {_uuid("m")} AS id, 'sha256:' || sha256(h) AS payload,
    'sha256:' || sha256('HTTP/1.1 200 OK' || nl || 'Content-Type: ' || kind || nl || 'Content-Length: ' || n || nl || nl || h) AS block
  FROM source),
made AS (
  SELECT *, {_squeezed(_unescape("regexp_extract(h, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)"))} AS title,
    list_transform(regexp_extract_all(gone, '(?is)<a\\b[^>]*?\\bhref\\s*=\\s*"([^"]*)"', 1), lambda x: {_squeezed(_unescape("x"))}) AS links,
    regexp_replace({_TEXT}, '^\\s+|\\s+$', '', 'g') AS content
  FROM named),
records AS (
  SELECT page_id, url, id, block, payload, 'metadata' AS record_type, 'application/warc-fields' AS content_type,
    'source-record-id: ' || id || nl || 'source-date: 2024-01-01T00:00:00Z' || nl || 'source-block-digest: ' || block || nl
    || 'source-payload-digest: ' || payload || nl || 'http-status: 200 OK' || nl || 'http-header-content-type: ' || kind || nl
    || 'http-header-content-length: ' || n || nl || CASE WHEN title <> '' THEN 'title: ' || title || nl ELSE '' END
    || coalesce(array_to_string(list_transform(list_filter(links, lambda x: x <> ''), lambda x: 'outlink: ' || x || nl), ''), '') AS body
  FROM made
  UNION ALL
  SELECT page_id, url, id, block, payload, 'conversion', 'text/plain; charset=utf-8', content FROM made),
keyed AS (SELECT *, md5(record_type || '|' || id || '|' || block) AS k FROM records)
SELECT page_id, record_type, {_uuid("k")} AS record_id, id AS refers_to, url AS refers_to_uri, '2024-01-01T00:00:00Z' AS refers_to_date,
  url AS target_uri, content_type, CAST(strlen(body) AS VARCHAR) AS content_length, 'sha256:' || sha256(body) AS block_digest, body,
  block AS source_block_digest, payload AS source_payload_digest
FROM keyed
"""
