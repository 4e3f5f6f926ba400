"""The queries again as SQL for DuckDB, written against the driver's tables."""

from __future__ import annotations

from .queries import AS_OF, MAX_BYTES, MAX_UPLOAD, QUOTA_BYTES, QUOTA_COUNT, TTL

# printf rounds the exact binary value half to even, as the results ask for.


def _r6(value: str) -> str:
    return f"CAST(printf('%.6f', CAST({value} AS DOUBLE)) AS DOUBLE)"


def _channel(shift: int) -> str:
    return (
        f"CAST(floor(least(greatest(CAST(embedding[(x + {shift}) % 64 + 1] AS DOUBLE) + 0.5, 0), 1)"
        " * 255) AS INTEGER)"
    )


PIXELS = f"""
px AS (
  SELECT vec_id // 64 AS image_id, CAST(x AS INTEGER) AS x, CAST(vec_id % 64 AS INTEGER) AS y,
         {_channel(0)} AS r, {_channel(21)} AS g, {_channel(42)} AS b
  FROM embeddings, (SELECT unnest(range(64)) AS x)
),
im AS (
  SELECT vec_id // 64 AS image_id, 64 AS width, CAST(count(*) AS INTEGER) AS height,
         count(*) * 192 AS byte_count
  FROM embeddings GROUP BY 1
)"""


def _compared(threshold: float = 0.55) -> str:
    return f"""{PIXELS},
pr AS (
  SELECT DISTINCT image_id // 2 AS pair_id, image_id // 2 * 2 AS before_id,
         image_id // 2 * 2 + 1 AS after_id
  FROM im
),
sized AS (
  SELECT pair_id, before_id, after_id, b.width AS bw, b.height AS bh, a.width AS aw, a.height AS ah,
         least(b.width, a.width) AS cw, least(b.height, a.height) AS ch,
         b.width * b.height + a.width * a.height
           - least(b.width, a.width) * least(b.height, a.height) AS union_area
  FROM pr JOIN im b ON b.image_id = before_id JOIN im a ON a.image_id = after_id
),
bp AS (SELECT pair_id, x, y, r, g, b FROM pr JOIN px ON px.image_id = before_id),
ap AS (SELECT pair_id, x, y, r, g, b FROM pr JOIN px ON px.image_id = after_id),
cv AS (
  SELECT coalesce(bp.pair_id, ap.pair_id) AS pair_id, coalesce(bp.x, ap.x) AS x,
         coalesce(bp.y, ap.y) AS y, ap.r AS ar, ap.g AS ag, ap.b AS ab,
         bp.pair_id IS NOT NULL AND ap.pair_id IS NOT NULL AS shared,
         CASE WHEN bp.pair_id IS NOT NULL AND ap.pair_id IS NOT NULL
              THEN abs(bp.r - ap.r) + abs(bp.g - ap.g) + abs(bp.b - ap.b) ELSE 0 END AS channel_sum,
         CASE WHEN bp.pair_id IS NOT NULL AND ap.pair_id IS NOT NULL
              THEN greatest(abs(bp.r - ap.r), abs(bp.g - ap.g), abs(bp.b - ap.b)) > {threshold} * 255.0
              ELSE true END AS changed
  FROM bp FULL OUTER JOIN ap ON bp.pair_id = ap.pair_id AND bp.x = ap.x AND bp.y = ap.y
),
totals AS (
  SELECT s.pair_id, bw AS before_width, bh AS before_height, aw AS after_width, ah AS after_height,
         (bw, bh) <> (aw, ah) AS dimensions_changed, cw AS comparison_width, ch AS comparison_height,
         count(*) FILTER (changed) AS changed_pixels,
         {_r6("count(*) FILTER (changed) / union_area")} AS changed_ratio,
         {_r6("greatest(0.0, 1.0 - (sum(channel_sum) / 3.0 + (union_area - cw * ch) * 255.0) / (union_area * 255.0))")} AS similarity
  FROM sized s JOIN cv USING (pair_id)
  GROUP BY s.pair_id, bw, bh, aw, ah, cw, ch, union_area
)"""


TILES = """
tl AS (
  SELECT pair_id, y // 16 AS ty, x // 16 AS tx, count(*) FILTER (changed) AS n,
         min(x) FILTER (changed) AS min_x, min(y) FILTER (changed) AS min_y,
         max(x) FILTER (changed) AS max_x, max(y) FILTER (changed) AS max_y,
         CAST(sum(channel_sum) AS BIGINT) AS channel_sum
  FROM cv GROUP BY 1, 2, 3
)"""

REGIONS = f"""{TILES},
ct AS (SELECT * FROM tl WHERE n > 0),
reach AS (
  SELECT pair_id, ty, tx, ty AS sy, tx AS sx FROM ct
  UNION
  SELECT r.pair_id, t.ty, t.tx, r.sy, r.sx FROM reach r JOIN ct t
    ON t.pair_id = r.pair_id AND abs(t.ty - r.ty) + abs(t.tx - r.tx) = 1
),
lab AS (
  SELECT pair_id, ty, tx, min(sy * 1048576 + sx) AS label FROM reach GROUP BY 1, 2, 3
),
comp AS (
  SELECT pair_id, label, CAST(sum(n) AS BIGINT) AS n, min(min_x) AS x, min(min_y) AS y,
         max(max_x) - min(min_x) + 1 AS width, max(max_y) - min(min_y) + 1 AS height
  FROM lab JOIN ct USING (pair_id, ty, tx) GROUP BY 1, 2
),
reg AS (
  SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY label) AS INTEGER) AS discovery,
         x, y, width, height, n AS changed_pixels
  FROM comp QUALIFY discovery <= 1000
),
ranked AS (
  SELECT pair_id, CAST(row_number() OVER (PARTITION BY pair_id
           ORDER BY changed_pixels DESC, y, x, discovery) AS INTEGER) AS rank,
         x, y, width, height, changed_pixels
  FROM reg
)"""

# Cells of 64 x 64 tiles are labelled by themselves; ``reach`` may cross them or not.
WIDE = """
rn AS (
  SELECT l_orderkey // 100 AS ty, l_orderkey % 100 AS tx, l_linenumber % 16 AS row,
         1 + CAST(max(l_quantity) AS INTEGER) % 16 AS run
  FROM lineitem WHERE (l_orderkey * 7 + l_orderkey // 13 * 5) % 9 < 4 GROUP BY 1, 2, 3
),
ct AS (
  SELECT CAST(0 AS BIGINT) AS pair_id, CAST(ty AS INTEGER) AS ty, CAST(tx AS INTEGER) AS tx, sum(run) AS n,
         CAST(tx * 16 AS INTEGER) AS min_x, CAST(ty * 16 + min(row) AS INTEGER) AS min_y,
         CAST(tx * 16 + max(run) - 1 AS INTEGER) AS max_x, CAST(ty * 16 + max(row) AS INTEGER) AS max_y
  FROM rn GROUP BY ty, tx
)"""


def _reach(inside: str = "") -> str:
    return f"""
reach AS (
  SELECT pair_id, ty, tx, ty AS sy, tx AS sx FROM ct
  UNION
  SELECT r.pair_id, t.ty, t.tx, r.sy, r.sx FROM reach r JOIN ct t
    ON t.pair_id = r.pair_id AND (t.ty = r.ty AND t.tx IN (r.tx - 1, r.tx + 1)
      OR t.tx = r.tx AND t.ty IN (r.ty - 1, r.ty + 1)) {inside}
)"""


LISTED = REGIONS[REGIONS.index("lab AS (") :]
WIDE_REGIONS = f"{WIDE}, {_reach()}, {LISTED}"

CROPS = f"""{PIXELS},
cr AS (
  SELECT p_partkey AS request_id, p_partkey % (SELECT max(vec_id) // 64 + 1 FROM embeddings) AS image_id,
         CAST(p_partkey * 7 % 70 AS INTEGER) AS x, CAST(p_partkey % 60 AS INTEGER) AS y,
         CAST(1 + p_size % 40 AS INTEGER) AS width, CAST(1 + p_partkey % 30 AS INTEGER) AS height,
         ['png', 'jpeg', 'webp'][p_partkey % 3 + 1] AS output_format
  FROM part
),
bx AS (
  SELECT cr.*, im.width AS iw, im.height AS ih, im.byte_count,
         CASE WHEN x >= im.width OR y >= im.height THEN 'Bounding box starts outside the image'
              WHEN x + cr.width > im.width OR y + cr.height > im.height
              THEN 'Bounding box extends beyond the image; boxes are never clamped' END AS message
  FROM cr JOIN im USING (image_id)
),
ok AS (
  SELECT *, least(16 / width, 16 / height, 1.0) AS scale FROM bx WHERE message IS NULL
),
ft AS (
  SELECT *, CASE WHEN scale < 1 THEN greatest(1, CAST(round_even(width * scale, 0) AS INTEGER))
                 ELSE width END AS output_width,
         CASE WHEN scale < 1 THEN greatest(1, CAST(round_even(height * scale, 0) AS INTEGER))
              ELSE height END AS output_height
  FROM ok
)"""

FIT_COLUMNS = f"""request_id, output_width, output_height,
  {_r6("x / iw")} AS box_x, {_r6("y / ih")} AS box_y,
  {_r6("width / iw")} AS box_width, {_r6("height / ih")} AS box_height"""

DOWNSCALED = "crop was downscaled to fit the requested maximum dimensions"


def _lanczos(table: str, size: str, target: str) -> str:
    """Fixed-point weights (size, target, o, i, w) for the geometries in ``table``."""
    return f"""(
  WITH geo AS (SELECT DISTINCT {size} AS size, {target} AS target FROM {table}),
  pos AS (
    SELECT size, target, o, i, (i - (o + 0.5) * size / target + 0.5) / greatest(size / target, 1) AS d
    FROM geo, LATERAL (SELECT unnest(range(target)) AS o), LATERAL (SELECT unnest(range(size)) AS i)
    WHERE i >= greatest(trunc((o + 0.5) * size / target - 3 * greatest(size / target, 1) + 0.5), 0)
      AND i < least(trunc((o + 0.5) * size / target + 3 * greatest(size / target, 1) + 0.5), size)
  ),
  raw AS (
    SELECT size, target, o, i,
           CASE WHEN abs(d) >= 3 THEN 0.0 WHEN d = 0 THEN 1.0
                ELSE sin(pi() * d) / (pi() * d) * sin(pi() * d / 3) / (pi() * d / 3) END AS w
    FROM pos
  )
  SELECT size, target, o, i,
         CAST(floor(w / sum(w) OVER (PARTITION BY size, target, o) * 4194304 + 0.5) AS BIGINT) AS w
  FROM raw
)"""


def _shrunk(channel: str) -> str:
    return f"CAST(least(255, greatest(0, (sum(w * {channel}) + 2097152) // 4194304)) AS INTEGER) AS {channel}"


LINES = """
ln AS (
  SELECT doc_id AS image_id, CAST(i - 1 AS INTEGER) AS ord, line AS text,
         CAST(12 * ((i - 1) * 17 % 50) AS DOUBLE) AS top, CAST((i - 1) * 7 % 40 AS DOUBLE) AS lft,
         CAST(least(600, 6 * length(line)) AS DOUBLE) AS width,
         CAST(1 + (i - 1) // 50 AS INTEGER) AS page, length(line) % 101 / 100.0 AS confidence
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)
),
bl AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY page, top, lft, ord) - 1 AS INTEGER) AS position
  FROM ln WHERE trim(text) <> ''
)"""

BOX = f"""
nb AS (
  SELECT image_id, position, 'b' || lpad(CAST(position AS VARCHAR), 4, '0') AS id,
         substr(text, 1, 4000) AS text, page, CAST(confidence AS DOUBLE) AS confidence,
         {_r6("lft / 640")} AS box_x, {_r6("top / 600")} AS box_y,
         {_r6("least((lft + width) / 640, 1) - least(lft / 640, 1)")} AS box_width,
         {_r6("least((top + 10) / 600, 1) - least(top / 600, 1)")} AS box_height,
         {_r6("least((lft + width) / 640, 1)")} AS third_x,
         {_r6("least((top + 10) / 600, 1)")} AS third_y
  FROM bl WHERE position < 500
)"""

_QUOTED = (
    "CASE WHEN regexp_matches(text, '[,\"\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"'"
    " ELSE text END"
)
CSV_LINE = (
    f"id || ',' || {_QUOTED} || ',' || printf('%.4f', confidence) || ',' || printf('%.6f', box_x)"
    " || ',' || printf('%.6f', box_y) || ',' || printf('%.6f', box_width) || ','"
    " || printf('%.6f', box_height)"
)
CSV_HEADER = "id,text,confidence,x,y,width,height"


def _content(expression: str) -> str:
    return f"""WITH {LINES}, {BOX},
joined AS (SELECT image_id, {expression} AS content FROM nb GROUP BY image_id)
SELECT image_id, substr(content, 1, 200000) AS content, length(content) > 200000 AS content_truncated
FROM joined"""


MANAGED = """
md AS (
  SELECT doc_id AS image_id, doc_id % 3 AS kind,
         len(string_split(text, chr(10))) AS line_count,
         CASE WHEN doc_id % 7 = 0 THEN 500 WHEN doc_id % 11 = 0 THEN 401 ELSE 200 END AS status
  FROM documents
)"""

_POINTS = """CAST(CAST(least({w}, lft) AS INTEGER) AS VARCHAR) || ',' || CAST(CAST(least({h}, top) AS INTEGER) AS VARCHAR)
  || ',' || CAST(CAST(least({w}, lft + width) AS INTEGER) AS VARCHAR) || ',' || CAST(CAST(least({h}, top) AS INTEGER) AS VARCHAR)
  || ',' || CAST(CAST(least({w}, lft + width) AS INTEGER) AS VARCHAR) || ',' || CAST(CAST(least({h}, top + 10) AS INTEGER) AS VARCHAR)
  || ',' || CAST(CAST(least({w}, lft) AS INTEGER) AS VARCHAR) || ',' || CAST(CAST(least({h}, top + 10) AS INTEGER) AS VARCHAR)"""

MARKDOWN = """(SELECT string_agg('# ' || CAST(image_id AS VARCHAR) || '.' || CAST(p AS VARCHAR), chr(10) || chr(10) ORDER BY p)
    FROM (SELECT unnest(range(0, (line_count - 1) // 50 + 1)) AS p))"""

_LOCAL = f"""WITH {LINES}
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS INTEGER) AS ord, text,
       'line' AS block_type, 1 AS page, {_POINTS.format(w=100000, h=100000)} AS polygon,
       CAST(confidence AS DOUBLE) AS confidence
FROM ln WHERE text <> '' AND image_id % 5 <> 0"""

ROUTED = f"""{LINES}, {MANAGED},
rt AS (
  SELECT image_id, status, status = 500 AS fallback_used,
         CASE WHEN status = 401 THEN 'forbidden'
              WHEN status = 500 AND image_id % 5 = 0 THEN 'quota_exceeded' END AS error_code
  FROM md
),
rb AS (
  SELECT rt.image_id, fallback_used, ord, text, top, lft, width, confidence,
         CASE WHEN fallback_used THEN 1 ELSE page END AS page
  FROM rt JOIN ln USING (image_id)
  WHERE error_code IS NULL AND CASE WHEN fallback_used THEN text <> '' ELSE trim(text) <> '' END
)"""

FELL_BACK = "fell back to the local provider after a retryable failure: provider_unavailable"

STATUS = """(SELECT * FROM (VALUES ('invalid_input', 400, false), ('unauthorized', 401, false),
  ('forbidden', 403, false), ('not_found', 404, false), ('payload_too_large', 413, false),
  ('unsupported_media', 415, false), ('quota_exceeded', 429, false), ('internal', 500, false),
  ('provider_error', 502, false), ('busy', 503, true), ('provider_unavailable', 503, true),
  ('timeout', 504, true)) AS t(code, http_status, retryable))"""

FILES = f"""
fl AS (
  SELECT '/uploads/' || CAST(doc_id AS VARCHAR) AS path, doc_id,
         CAST(CASE doc_id % 5 WHEN 0 THEN 24 WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 3 THEN 6 ELSE 0 END
           + CASE WHEN doc_id % 5 = 4 THEN 0 ELSE strlen(text) END AS BIGINT) AS byte_count,
         CASE doc_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/webp' END AS content_type,
         (1 + doc_id * 37 % 9000) * (1 + doc_id * 53 % 9000) AS pixels
  FROM documents
),
pg AS (
  SELECT *, CASE WHEN byte_count = 0 THEN 'invalid_input'
                 WHEN byte_count > {MAX_BYTES} THEN 'payload_too_large'
                 WHEN content_type IS NULL THEN 'unsupported_media'
                 WHEN content_type = 'image/png' AND pixels > 40000000 THEN 'payload_too_large'
            END AS error_code
  FROM fl
)"""

PATHS = """
pp AS (
  SELECT page_id, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS clean, page_id % 7 <> 0 AS present,
         page_id % 10 AS form
  FROM pages
),
np AS (
  SELECT page_id, present, form,
         CASE WHEN form <= 1 THEN NULL WHEN form = 2 THEN clean WHEN form = 3 THEN '/private' || clean
              WHEN form = 4 THEN '/en' ELSE clean END AS path
  FROM pp
)"""

UPLOADS = f"""
up AS (
  SELECT CASE WHEN event_id % 2 = 1 THEN 'a' ELSE 'i' END || lpad(CAST(event_id AS VARCHAR), 12, '0') AS asset_id,
         event_id, CASE WHEN event_id % 2 = 1 THEN 'artifact' ELSE 'input' END AS kind,
         'p_' || CAST(user_id AS VARCHAR) AS principal,
         CASE event_type WHEN 'click' THEN 'image/png' WHEN 'view' THEN 'image/jpeg'
              WHEN 'purchase' THEN 'image/webp' WHEN 'signup' THEN 'application/pdf'
              WHEN 'error' THEN 'image/png' END AS content_type,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value * 1000) AS BIGINT) END AS byte_count,
         ts AS created_at, date_trunc('second', ts) + INTERVAL {TTL} SECOND AS expires_at
  FROM events
),
ug AS (
  SELECT *, CASE WHEN content_type NOT IN ('image/png', 'image/jpeg', 'image/webp') THEN 'unsupported_media'
                 WHEN byte_count > {MAX_UPLOAD} THEN 'payload_too_large'
                 WHEN byte_count = 0 THEN 'invalid_input' END AS error_code
  FROM up
)"""

def _admission(held: bool = False) -> str:
    mine = "event_id % 10 <> 0" if held else "true"
    begin = (
        f"""(SELECT list(struct_pack(e := CASE WHEN event_id % 20 <> 0 THEN expires_at ELSE TIMESTAMP '9999-01-01' END,
           b := byte_count)) FROM up WHERE up.principal = p.principal AND event_id % 10 = 0)"""
        if held
        else "NULL"
    )
    return f"""WITH RECURSIVE {UPLOADS},
el AS (
  SELECT *, row_number() OVER (PARTITION BY principal ORDER BY created_at, asset_id) AS step
  FROM ug WHERE error_code IS NULL AND {mine}
),
fold AS (
  SELECT principal, CAST(0 AS BIGINT) AS step, CAST(NULL AS VARCHAR) AS asset_id, false AS fits,
         coalesce({begin}, CAST([] AS STRUCT(e TIMESTAMP, b BIGINT)[])) AS live
  FROM (SELECT DISTINCT principal FROM el) p
  UNION ALL
  SELECT principal, step, asset_id, fits,
         CASE WHEN fits THEN list_append(kept, struct_pack(e := expires_at, b := byte_count)) ELSE kept END
  FROM (
    SELECT *, len(kept) + 1 <= {QUOTA_COUNT}
           AND coalesce(list_sum(list_transform(kept, lambda k: k.b)), 0) + byte_count <= {QUOTA_BYTES} AS fits
    FROM (
      SELECT el.principal, el.step, el.asset_id, el.expires_at, el.byte_count,
             list_filter(fold.live, lambda k: k.e > el.created_at) AS kept
      FROM fold JOIN el ON el.principal = fold.principal AND el.step = fold.step + 1
    )
  )
)
SELECT asset_id, principal, byte_count, created_at, error_code AS decision FROM ug WHERE error_code IS NOT NULL AND {mine}
UNION ALL
SELECT el.asset_id, el.principal, el.byte_count, el.created_at,
       CASE WHEN fits THEN 'accepted' ELSE 'quota_exceeded' END
FROM fold JOIN el ON el.principal = fold.principal AND el.step = fold.step"""


def _rollup(closed: bool) -> str:
    """``closed``: the windows that a stream has closed, an hour behind the last request it saw."""
    seen = "WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('ms', max(ts)) - INTERVAL 1 HOUR FROM rq)"
    return f"""WITH rq AS (
  SELECT ts, '/tools/' || event_type AS path, value AS duration_ms,
         [200, 200, 200, 200, 400, 404, 413, 429, 503, 504][event_id % 10 + 1] AS status
  FROM events
)
SELECT date_trunc('hour', ts) AS window_start, path, status, count(*) AS calls,
       avg(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS error_share,
       avg(CASE WHEN status IN (503, 504) THEN 1 ELSE 0 END) AS retryable_share,
       CAST(printf('%.4f', avg(duration_ms)) AS DOUBLE) AS mean_ms, max(duration_ms) AS max_ms,
       quantile_disc(duration_ms, 0.5) AS p50_ms, quantile_disc(duration_ms, 0.95) AS p95_ms
FROM rq {seen if closed else ""} GROUP BY 1, 2, 3"""


def _param_rules(rules: list[tuple[str, str, str]]) -> str:
    texts = ", ".join(f"CASE WHEN {broken} THEN '{where}: {text}' END" for where, broken, text in rules)
    return f"list_filter([{texts}], lambda e: e IS NOT NULL)"


def _low(where: str, value: str, limit: int) -> tuple[str, str, str]:
    return where, f"{value} < {limit}", f"Input should be greater than or equal to {limit}"


def _high(where: str, value: str, limit: int) -> tuple[str, str, str]:
    return where, f"{value} > {limit}", f"Input should be less than or equal to {limit}"


def _more(where: str, value: str, limit: int) -> tuple[str, str, str]:
    return where, f"{value} <= {limit}", f"Input should be greater than {limit}"


COMPARE_RULES = _param_rules(
    [
        _low("threshold", "(p_size - 5) / 40.0", 0),
        _high("threshold", "(p_size - 5) / 40.0", 1),
        _low("maxRegions", "(p_size * 3 - 6)", 1),
        _high("maxRegions", "(p_size * 3 - 6)", 100),
    ]
)
CROP_RULES = _param_rules(
    [
        _low("box.x", "(p_size - 3)", 0),
        _low("box.y", "p_size", 0),
        ("box.y", "p_size = 7", "Input should be less than or equal to 1000000"),
        _more("box.width", "(p_size - 2)", 0),
        _more("box.height", "(p_size - 4)", 0),
        _low("maxWidth", "(p_size * 2)", 16),
        _high("maxWidth", "(p_size * 2)", 8192),
        _low("maxHeight", "(p_size * 400)", 16),
        _high("maxHeight", "(p_size * 400)", 8192),
        _low("quality", "(p_size * 3)", 1),
        _high("quality", "(p_size * 3)", 100),
    ]
)


def _first(rules: str) -> str:
    return f"CASE WHEN len({rules}) > 0 THEN array_to_string(list_slice({rules}, 1, 5), '; ') END"


_CROP_PIXELS = f"""WITH {CROPS}
SELECT request_id, px.x - ok.x AS x, px.y - ok.y AS y, r, g, b
FROM ok JOIN px ON px.image_id = ok.image_id AND px.x >= ok.x AND px.x < ok.x + ok.width
  AND px.y >= ok.y AND px.y < ok.y + ok.height"""

_RESAMPLE = f"""WITH {CROPS},
sm AS (SELECT * FROM ft WHERE scale < 1),
pt AS MATERIALIZED (SELECT * FROM px),
ln AS (SELECT *, unnest(range(CAST(height AS BIGINT))) AS dy FROM sm),
sp AS (SELECT *, unnest(range(CAST(width AS BIGINT))) AS dx FROM ln),
cp AS MATERIALIZED (
  SELECT request_id, sp.width, sp.height, output_width, output_height, dx AS x, dy AS y, r, g, b
  FROM sp JOIN pt ON pt.image_id = sp.image_id AND pt.x = sp.x + dx AND pt.y = sp.y + dy
),
across AS (
  SELECT request_id, height, output_height, y, o AS x, {_shrunk("r")}, {_shrunk("g")}, {_shrunk("b")}
  FROM cp JOIN {_lanczos("sm", "width", "output_width")} k
    ON k.size = cp.width AND k.target = cp.output_width AND k.i = cp.x
  GROUP BY request_id, height, output_height, y, o
)
SELECT request_id, CAST(x AS INTEGER) AS x, CAST(o AS INTEGER) AS y, {_shrunk("r")}, {_shrunk("g")}, {_shrunk("b")}
FROM across JOIN {_lanczos("sm", "height", "output_height")} k
  ON k.size = across.height AND k.target = across.output_height AND k.i = across.y
GROUP BY request_id, x, o"""


RESOLVED = f"""WITH {UPLOADS}, {PATHS},
files AS (SELECT rtrim(path, '/') AS path, max(page_id) AS byte_count FROM np WHERE present AND form > 4 GROUP BY 1),
raw AS (
  SELECT page_id, form,
         CASE form WHEN 0 THEN rtrim(substr(clean, 2), '/') WHEN 1 THEN clean || chr(0)
              ELSE rtrim(path, '/') END AS path
  FROM pp JOIN np USING (page_id, present, form)
),
asked AS (
  SELECT page_id, form, path, 'a' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS asset_id,
         'p_' || CAST(user_id AS VARCHAR) AS principal
  FROM raw JOIN events ON event_id = page_id
)
SELECT page_id AS reference_id, 'local_path' AS source_kind,
       CASE form WHEN 0 THEN '/' || asked.path ELSE asked.path END AS path, CAST(NULL AS VARCHAR) AS asset_id,
       files.byte_count,
       CASE WHEN form <= 1 THEN 'invalid_input' WHEN files.path IS NULL THEN 'not_found'
            WHEN asked.path IN ('/en', '/es') OR asked.path LIKE '/en/%' OR asked.path LIKE '/es/%' THEN NULL
            ELSE 'forbidden' END AS error_code
FROM asked LEFT JOIN files ON files.path = CASE form WHEN 0 THEN '/' || asked.path ELSE asked.path END
WHERE page_id % 2 = 0
UNION ALL
SELECT page_id, 'asset', NULL, asked.asset_id, up.byte_count,
       CASE WHEN up.asset_id IS NULL THEN 'not_found' END
FROM asked LEFT JOIN up ON up.asset_id = asked.asset_id AND up.principal = asked.principal
  AND up.expires_at > TIMESTAMP '2024-01-01 18:00:00'
WHERE page_id % 2 = 1"""

ORACLES: dict[str, str] = {
    "compare_totals": f"WITH {_compared()} SELECT * FROM totals",
    "compare_totals_sparse": f"WITH {_compared(0.6)} SELECT * FROM totals",
    "compare_tiles": f"WITH {_compared()}, {TILES} SELECT * FROM tl WHERE n > 0 OR channel_sum > 0",
    "compare_regions": f"WITH RECURSIVE {_compared()}, {REGIONS} SELECT * FROM reg",
    "compare_topk": f"WITH RECURSIVE {_compared()}, {REGIONS} SELECT * FROM ranked WHERE rank <= 2",
    "compare_images": f"""WITH RECURSIVE {_compared()}, {REGIONS},
listed AS (
  SELECT pair_id, count(*) AS found,
         string_agg(concat_ws(',', x, y, width, height, changed_pixels), '|' ORDER BY rank)
           FILTER (rank <= 20) AS regions
  FROM ranked GROUP BY pair_id
)
SELECT t.*, coalesce(regions, '') AS regions, changed_pixels > 0 AS has_diff,
       coalesce(found, 0) > 20 AS truncated,
       concat_ws('|',
         CASE WHEN dimensions_changed THEN 'images differ in size; non-overlapping pixels count as changed' END,
         CASE WHEN coalesce(found, 0) > 20 THEN 'changed region list truncated to 20 entries' END,
         CASE WHEN changed_pixels = 0 THEN 'diff image was not produced because no pixels changed' END
       ) AS warnings,
       CAST(NULL AS VARCHAR) AS error_code
FROM totals t LEFT JOIN listed USING (pair_id)""",
    "compare_regions_wide": f"WITH RECURSIVE {WIDE_REGIONS} SELECT * FROM reg",
    "compare_images_wide": f"""WITH RECURSIVE {WIDE_REGIONS},
size AS (SELECT (max(l_orderkey) // 100 + 1) * 16 AS h FROM lineitem),
total AS (SELECT sum(n) AS n, sum(n) * 255 AS channel_sum FROM ct),
listed AS (
  SELECT count(*) AS found,
         string_agg(concat_ws(',', x, y, width, height, changed_pixels), '|' ORDER BY rank)
           FILTER (rank <= 20) AS regions
  FROM ranked
)
SELECT CAST(0 AS BIGINT) AS pair_id, 1600 AS before_width, CAST(h AS INTEGER) AS before_height, 1600 AS after_width,
       CAST(h AS INTEGER) AS after_height, false AS dimensions_changed, 1600 AS comparison_width,
       CAST(h AS INTEGER) AS comparison_height, CAST(n AS BIGINT) AS changed_pixels,
       {_r6("n / (1600 * h)")} AS changed_ratio,
       {_r6("greatest(0.0, 1.0 - (channel_sum / 3.0) / (1600 * h * 255.0))")} AS similarity,
       regions, false AS has_diff, found > 20 AS truncated,
       CASE WHEN found > 20 THEN 'changed region list truncated to 20 entries' ELSE '' END AS warnings,
       CAST(NULL AS VARCHAR) AS error_code
FROM size, total, listed""",
    "tile_adjacency": f"""WITH RECURSIVE {WIDE},
{_reach("AND t.ty // 64 = r.ty // 64 AND t.tx // 64 = r.tx // 64")},
lab AS (SELECT pair_id, ty, tx, min(sy * 1048576 + sx) AS label FROM reach GROUP BY 1, 2, 3)
SELECT DISTINCT a.pair_id, CAST(greatest(a.label, b.label) AS BIGINT) AS upper, CAST(least(a.label, b.label) AS BIGINT) AS lower
FROM lab a JOIN lab b ON b.ty = a.ty + 1 AND b.tx = a.tx AND b.ty % 64 = 0
                      OR b.tx = a.tx + 1 AND b.ty = a.ty AND b.tx % 64 = 0""",
    "diff_raster": f"""WITH {_compared()}
SELECT pair_id, x, y,
       CASE WHEN changed THEN 255 ELSE (ar * 19595 + ag * 38470 + ab * 7471 + 32768) >> 16 END AS r,
       CASE WHEN changed THEN 0 ELSE (ar * 19595 + ag * 38470 + ab * 7471 + 32768) >> 16 END AS g,
       CASE WHEN changed THEN 0 ELSE (ar * 19595 + ag * 38470 + ab * 7471 + 32768) >> 16 END AS b
FROM cv WHERE pair_id IN (SELECT pair_id FROM totals WHERE changed_pixels > 0)""",
    "diff_artifacts": f"""WITH {_compared()},
answers AS (
  SELECT pair_id, changed_pixels > 0 AS has_diff,
         CASE WHEN changed_pixels > 0 THEN CAST(ceil(greatest(bw, aw) / 16.0) * ceil(greatest(bh, ah) / 16.0) AS BIGINT) END AS n
  FROM totals JOIN sized USING (pair_id)
)
SELECT CAST(run AS INTEGER) AS run, pair_id + shift AS pair_id, CASE WHEN has_diff THEN pair_id END AS first_pair, n AS stored_tiles, has_diff
FROM answers, (VALUES (1, 0), (2, 0), (2, 1000)) AS runs(run, shift)""",
    "orient_pixels": f"""WITH {PIXELS},
o AS (SELECT px.*, width, height, image_id % 8 + 1 AS turn FROM px JOIN im USING (image_id))
SELECT image_id,
       CAST(CASE turn WHEN 1 THEN x WHEN 2 THEN width - 1 - x WHEN 3 THEN width - 1 - x WHEN 4 THEN x
            WHEN 5 THEN y WHEN 6 THEN height - 1 - y WHEN 7 THEN height - 1 - y ELSE y END AS INTEGER) AS x,
       CAST(CASE turn WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN height - 1 - y WHEN 4 THEN height - 1 - y
            WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN width - 1 - x ELSE width - 1 - x END AS INTEGER) AS y,
       r, g, b
FROM o""",
    "box_gate": f"""WITH {CROPS}
SELECT request_id, CASE WHEN message IS NOT NULL THEN 'invalid_input' END AS error_code, message,
       CASE WHEN message LIKE '%beyond%' THEN CAST(ih AS VARCHAR) END AS image_height
FROM bx""",
    "gated_requests": f"""WITH {CROPS},
rq AS (
  SELECT request_id, request_id % 5 AS shift, image_id, iw, ih, width, height,
         CASE WHEN request_id % 5 = 1 THEN -x - 1 ELSE x END AS x, y
  FROM bx
)
SELECT request_id,
       CASE WHEN shift IN (1, 2, 3) THEN 'invalid_input' WHEN shift = 4 THEN 'not_found'
            WHEN image_id % 3 = 1 THEN 'payload_too_large'
            WHEN x >= iw OR y >= ih OR x + width > iw OR y + height > ih THEN 'invalid_input' END AS error_code
FROM rq""",
    "fit_scale": f"""WITH {CROPS}
SELECT {FIT_COLUMNS}, scale < 1 AS downscaled, CASE WHEN scale < 1 THEN '{DOWNSCALED}' ELSE '' END AS warnings
FROM ft""",
    "crop_pixels": _CROP_PIXELS,
    "crop_stored": _CROP_PIXELS,
    "resample": _RESAMPLE,
    "region_rasters": _RESAMPLE + """
UNION ALL
SELECT request_id, CAST(dx AS INTEGER) AS x, CAST(dy AS INTEGER) AS y, r, g, b
FROM (SELECT *, unnest(range(CAST(width AS BIGINT))) AS dx
      FROM (SELECT *, unnest(range(CAST(height AS BIGINT))) AS dy FROM ft WHERE scale = 1)) AS f
  JOIN pt ON pt.image_id = f.image_id AND pt.x = f.x + dx AND pt.y = f.y + dy""",
    "asset_ledger": f"""WITH {UPLOADS}
SELECT asset_id, principal, kind, byte_count, date_trunc('second', created_at) AS created_at, expires_at FROM up""",
    "content_sink": "WITH t AS (" + _content("string_agg(text, chr(10) ORDER BY position)") + "), c AS (" + _content(
        f"'{CSV_HEADER}' || chr(10) || string_agg({CSV_LINE}, chr(10) ORDER BY position) || chr(10)"
    ) + """)
SELECT image_id, 'text' AS output_format, sha256(content) AS digest FROM t
UNION ALL SELECT image_id, 'csv', sha256(content) FROM c""",
    "decoder_hook": f"WITH {PIXELS} SELECT image_id, x, y, r, g, b FROM px WHERE image_id % 5 <> 4",
    "scan_gate": f"""WITH {FILES}
SELECT path, byte_count, CASE WHEN byte_count <= {MAX_BYTES} THEN content_type END AS content_type, error_code FROM pg""",
    "scan_images": f"WITH {FILES} SELECT path, byte_count, error_code FROM pg WHERE byte_count > 0",
    "stream_files": f"WITH {FILES} SELECT path, byte_count, error_code FROM pg WHERE byte_count > 0",
    "decode_tiles": f"WITH {PIXELS} SELECT image_id, x, y, r, g, b FROM px WHERE image_id % 5 <> 4",
    "image_rgb": f"WITH {PIXELS} SELECT image_id, x, y, r, g, b FROM px WHERE image_id % 5 <> 4",
    "decoded_files": f"""WITH {PIXELS}
SELECT image_id, 'image/png' AS content_type, CASE WHEN image_id % 5 <> 4 THEN width END AS width,
       CASE WHEN image_id % 5 <> 4 THEN height END AS height, CASE WHEN image_id % 5 = 4 THEN 'invalid_input' END AS error_code
FROM im""",
    "stored_assets": """WITH u AS (
  SELECT user_id, count(*) AS n, date_trunc('second', max(ts)) AS created_at, user_id % 7 = 3 AS broken FROM events
  WHERE true GROUP BY user_id
)
SELECT 'i' || lpad(CAST(user_id AS VARCHAR), 32, '0') AS asset_id, CAST(user_id AS VARCHAR) AS principal_bucket,
       CASE WHEN NOT broken THEN n END AS byte_count, n AS stored_bytes,
       CASE WHEN NOT broken THEN created_at END AS created_at, broken AS orphan
FROM u WHERE user_id % 5 <> 2""",
    "fallback_run": """WITH l AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda v: trim(v, ' ' || chr(9) || chr(13))) AS lines
  FROM documents
)
SELECT doc_id AS image_id, len(lines) > 40 AS fallback_used, CAST(NULL AS VARCHAR) AS error_code,
       CAST(len(list_filter(lines, lambda v: v <> '')) AS INTEGER) AS block_count
FROM l""",
    "engine_hook": """WITH l AS (
  SELECT doc_id, list_transform(string_split(text, chr(10)), lambda v: trim(v, ' ' || chr(9) || chr(13))) AS lines
  FROM documents
)
SELECT doc_id AS image_id, CASE WHEN len(lines) > 40 THEN 0 ELSE 200 END AS status,
       CASE WHEN len(lines) > 40 THEN 'timeout' END AS error_code,
       CASE WHEN len(lines) <= 40 THEN CAST(len(list_filter(lines, lambda v: v <> '')) AS INTEGER) END AS block_count
FROM l""",
    "optimize_regions": f"""WITH {CROPS}
SELECT bx.request_id, bx.image_id, bx.iw AS image_width, bx.ih AS image_height, bx.width AS crop_width,
       bx.height AS crop_height, output_width, output_height,
       CAST(output_width AS BIGINT) * output_height * 3 AS byte_count, bx.byte_count AS original_byte_count,
       bx.output_format, CASE WHEN bx.message IS NOT NULL THEN 'invalid_input' END AS error_code
FROM bx LEFT JOIN ft USING (request_id)""",
    "changed_crops": f"""WITH RECURSIVE {_compared()}, {REGIONS},
cr AS (
  SELECT CAST(pair_id AS VARCHAR) || ':' || CAST(rank - 1 AS VARCHAR) AS request_id, after_id AS image_id,
         x, y, width, height, aw AS iw, ah AS ih, least(16 / width, 16 / height, 1.0) AS scale
  FROM ranked JOIN sized USING (pair_id)
  WHERE rank <= 20 AND x + width <= aw AND y + height <= ah
),
ft AS (
  SELECT *, CASE WHEN scale < 1 THEN greatest(1, CAST(round_even(width * scale, 0) AS INTEGER))
                 ELSE width END AS output_width,
         CASE WHEN scale < 1 THEN greatest(1, CAST(round_even(height * scale, 0) AS INTEGER))
              ELSE height END AS output_height
  FROM cr
)
SELECT {FIT_COLUMNS}, image_id, x, y, width, height, scale < 1 AS downscaled FROM ft""",
    "byte_savings": f"""WITH {CROPS}
SELECT output_format, count(*) AS requests, CAST(sum(byte_count) AS BIGINT) AS original_bytes,
       CAST(sum(output_width * output_height * 3) AS BIGINT) AS output_bytes,
       {_r6("1.0 - sum(output_width * output_height * 3) / sum(byte_count)")} AS saved_ratio
FROM ft GROUP BY 1""",
    "ocr_managed": f"""WITH {LINES}, {MANAGED}
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY ord) - 1 AS INTEGER) AS ord, text,
       ['paragraph', 'line', 'word'][kind + 1] AS block_type, page,
       {_POINTS.format(w=320, h=300)} AS polygon, CAST(confidence AS DOUBLE) AS confidence
FROM ln JOIN md USING (image_id) WHERE trim(text) <> '' AND status = 200""",
    "ocr_documents": f"""WITH {LINES}, {MANAGED},
cnt AS (SELECT image_id, CAST(count(*) FILTER (trim(text) <> '') AS INTEGER) AS n FROM ln GROUP BY 1)
SELECT image_id, status,
       CASE status WHEN 500 THEN 'provider_unavailable' WHEN 401 THEN 'forbidden' END AS error_code,
       CASE WHEN status = 200 THEN 'ok' ELSE 'failed' END AS state,
       CASE WHEN status = 200 THEN {MARKDOWN} END AS markdown,
       CASE WHEN status = 200 THEN '' END AS warnings, CASE WHEN status = 200 THEN n END AS block_count
FROM md JOIN cnt USING (image_id)""",
    "ocr_local": _LOCAL,
    "ocr_local_legacy": _LOCAL,
    "reading_order": f"WITH {LINES} SELECT image_id, position, ord, page, text FROM bl WHERE position < 500",
    "normalized_boxes": f"""WITH {LINES}, {BOX}
SELECT image_id, id, 'line' AS type, page, confidence, box_x, box_y, box_width, box_height,
       third_x, third_y, CAST(length(text) AS INTEGER) AS text_length
FROM nb""",
    "block_cap": f"""WITH {LINES}
SELECT image_id, count(*) AS block_count, count(*) > 20 AS truncated,
       least(count(*), 20) AS kept,
       'b' || lpad(CAST(least(count(*), 20) - 1 AS VARCHAR), 4, '0') AS last_id
FROM bl GROUP BY image_id""",
    "content_text": _content("string_agg(text, chr(10) ORDER BY position)"),
    "content_markdown": _content("string_agg('- ' || text, chr(10) ORDER BY position)"),
    "content_csv": _content(
        f"'{CSV_HEADER}' || chr(10) || string_agg({CSV_LINE}, chr(10) ORDER BY position) || chr(10)"
    ),
    "provider_fallback": f"""WITH {ROUTED},
cnt AS (SELECT image_id, CAST(count(*) AS INTEGER) AS n FROM rb GROUP BY 1)
SELECT rt.image_id,
       CASE WHEN fallback_used THEN 'local_paddleocr' ELSE 'azure_content_understanding' END AS provider_name,
       CASE WHEN fallback_used THEN 'local' ELSE 'azure' END AS provider_mode,
       CASE WHEN fallback_used THEN 'PP-OCRv5' ELSE 'prebuilt-documentAnalyzer' END AS provider_model,
       CASE WHEN NOT fallback_used THEN '2025-11-01' END AS provider_api_version,
       fallback_used, error_code, http_status, retryable,
       CASE WHEN error_code IS NOT NULL THEN NULL WHEN fallback_used THEN '{FELL_BACK}' ELSE '' END AS warnings,
       CASE WHEN error_code IS NULL THEN coalesce(n, 0) END AS block_count
FROM rt LEFT JOIN cnt USING (image_id) LEFT JOIN {STATUS} s ON s.code = error_code""",
    "extract_layout": f"""WITH {ROUTED},
od AS (
  SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY page, top, lft, ord) - 1 AS position FROM rb
),
sh AS (
  SELECT image_id, position, 'b' || lpad(CAST(position AS VARCHAR), 4, '0') AS id, substr(text, 1, 4000) AS text,
         confidence, {_r6("lft / 640")} AS box_x, {_r6("top / 600")} AS box_y,
         {_r6("(lft + width) / 640 - lft / 640")} AS box_width,
         {_r6("(top + 10) / 600 - top / 600")} AS box_height
  FROM od WHERE position < 500
),
js AS (
  SELECT image_id, string_agg({CSV_LINE}, chr(10) ORDER BY position) || chr(10) AS lines,
         CAST(count(*) AS INTEGER) AS kept
  FROM sh GROUP BY 1
),
ct AS (SELECT image_id, count(*) AS n FROM rb GROUP BY 1),
al AS (
  SELECT rt.image_id, fallback_used, error_code, coalesce(kept, 0) AS kept, coalesce(n, 0) AS n,
         '{CSV_HEADER}' || chr(10) || coalesce(lines, '') AS content
  FROM rt LEFT JOIN js USING (image_id) LEFT JOIN ct USING (image_id)
)
SELECT image_id, CASE WHEN error_code IS NULL THEN substr(content, 1, 200000) END AS content,
       CASE WHEN error_code IS NULL THEN kept END AS block_count, 640 AS width, 600 AS height,
       CASE WHEN fallback_used THEN 'local_paddleocr' ELSE 'azure_content_understanding' END AS provider_name,
       fallback_used, CASE WHEN error_code IS NULL THEN n > 500 OR length(content) > 200000 END AS truncated,
       CASE WHEN error_code IS NULL THEN concat_ws('|', CASE WHEN fallback_used THEN '{FELL_BACK}' END,
         CASE WHEN n > 500 THEN 'block list truncated to 500 entries' END,
         CASE WHEN length(content) > 200000 THEN 'formatted content truncated' END) END AS warnings,
       error_code
FROM al""",
    "sniff": f"WITH {FILES} SELECT path, byte_count, content_type FROM fl",
    "payload_gate": f"""WITH {FILES}
SELECT path, error_code, http_status, retryable FROM pg LEFT JOIN {STATUS} s ON s.code = error_code""",
    "path_gate": f"""WITH {PATHS}
SELECT page_id, CASE WHEN form <= 1 THEN 'invalid_input' WHEN NOT present THEN 'not_found'
  WHEN path IN ('/en', '/es') OR path LIKE '/en/%' OR path LIKE '/es/%' THEN NULL
  ELSE 'forbidden' END AS error_code
FROM np""",
    "contained_paths": f"""WITH {PATHS},
roots AS (SELECT DISTINCT '/' || lang AS root FROM documents)
SELECT page_id FROM np WHERE form > 1 AND EXISTS (
  SELECT 1 FROM roots WHERE np.path = root OR starts_with(np.path, root || '/'))""",
    "reference_gate": """WITH f AS (
  SELECT page_id, url, page_id % 9 AS form, 'i' || lpad(CAST(page_id AS VARCHAR), 12, '0') AS ident FROM pages
)
SELECT page_id,
       CASE WHEN form = 0 THEN 'local_path' WHEN form = 1 OR (form = 7 AND page_id >= 1000000) THEN 'asset' END AS kind,
       CASE WHEN form = 0 THEN url END AS path,
       CASE WHEN form = 1 THEN ident WHEN form = 7 AND page_id >= 1000000 THEN 'i' || CAST(page_id AS VARCHAR) END AS asset_id,
       CASE WHEN form NOT IN (0, 1) AND NOT (form = 7 AND page_id >= 1000000) THEN 'invalid_input' END AS error_code
FROM f""",
    "param_gate": f"""SELECT p_partkey AS request_id, CAST(len({COMPARE_RULES}) AS INTEGER) AS compare_error_count,
       {_first(COMPARE_RULES)} AS compare_errors, CAST(len({CROP_RULES}) AS INTEGER) AS crop_error_count,
       {_first(CROP_RULES)} AS crop_errors
FROM part""",
    "language_gate": """SELECT doc_id, CASE WHEN doc_id % 4 <> 0 THEN lang ELSE 'en' END AS language,
       CASE WHEN doc_id % 2 = 0 AND doc_id % 4 <> 0 AND lang NOT IN ('en', 'fr') THEN 'invalid_input' END AS error_code,
       CASE doc_id % 5 WHEN 0 THEN 'language: String should have at least 2 characters'
            WHEN 1 THEN 'language: String should match pattern ''^[A-Za-z0-9_-]+$'''
            WHEN 2 THEN 'language: String should have at most 16 characters' END AS errors
FROM documents""",
    "content_type_gate": f"WITH {UPLOADS} SELECT asset_id, content_type, error_code FROM ug",
    "quarantine": f"""WITH {UPLOADS}
SELECT error_code AS code, false AS retryable, count(*) AS uploads, CAST(sum(byte_count) AS BIGINT) AS bytes
FROM ug WHERE error_code IS NOT NULL GROUP BY 1""",
    "error_details": """WITH w AS (
  SELECT doc_id, list_slice(list_filter(string_split(text, ' '), lambda w: w <> ''), 1, 10) AS words FROM documents
)
SELECT doc_id,
       array_to_string(list_transform(range(len(words)), lambda i: 'word ' || lpad(CAST(i AS VARCHAR), 6, '0')), '|') AS keys,
       array_to_string(list_transform(words, lambda w: substr(repeat(w, 40), 1, 200)), '|') AS details
FROM w""",
    "asset_expiry": f"""WITH {UPLOADS}
SELECT asset_id, kind, substr(principal, 3) AS principal_bucket,
       date_trunc('second', created_at) AS created_at, expires_at
FROM up""",
    "visible_assets": f"""WITH {UPLOADS}
SELECT event_id AS request_id, asset_id,
       CASE WHEN event_id % 4 <> 0 AND expires_at > TIMESTAMP '{AS_OF}' THEN byte_count END AS byte_count,
       CASE WHEN NOT (event_id % 4 <> 0 AND expires_at > TIMESTAMP '{AS_OF}') THEN 'not_found' END AS error_code
FROM up""",
    "resolve_references": RESOLVED,
    "reference_contents": f"""WITH rr AS ({RESOLVED}),
named AS (SELECT *, CASE WHEN error_code IS NULL THEN coalesce(path, asset_id) END AS id FROM rr),
held AS (SELECT *, id IS NOT NULL AND length(id) % 7 <> 3 AS there, id IS NOT NULL AND length(id) % 5 = 0 AS gif FROM named)
SELECT reference_id, source_kind, CASE WHEN there AND NOT gif THEN 'image/jpeg' END AS content_type,
       CASE WHEN there THEN CAST(strlen(id) + CASE WHEN gif THEN 6 ELSE 3 END AS BIGINT) WHEN id IS NULL THEN byte_count END AS byte_count,
       CASE WHEN there AND NOT gif THEN id END AS says,
       CASE WHEN id IS NULL THEN error_code WHEN NOT there THEN 'not_found' WHEN gif THEN 'unsupported_media' END AS error_code
FROM held""",
    "quota_usage": f"""WITH {UPLOADS}
SELECT principal, count(*) AS asset_count, CAST(sum(byte_count) AS BIGINT) AS total_bytes
FROM up WHERE expires_at > TIMESTAMP '{AS_OF}' GROUP BY 1""",
    "container_usage": f"""WITH {UPLOADS}
SELECT principal, kind, count(*) AS asset_count, CAST(sum(byte_count) AS BIGINT) AS total_bytes
FROM up WHERE expires_at > TIMESTAMP '{AS_OF}' GROUP BY 1, 2""",
    "purge_expired": f"""WITH {UPLOADS}
SELECT kind, count(*) FILTER (expires_at <= TIMESTAMP '{AS_OF}') AS removed,
       count(*) FILTER (expires_at > TIMESTAMP '{AS_OF}') AS kept
FROM up GROUP BY 1""",
    "purge_rewrite": f"""WITH {UPLOADS}
SELECT asset_id, principal, kind, byte_count FROM up WHERE expires_at > TIMESTAMP '{AS_OF}'""",
    "purge_manifest": f"""WITH {UPLOADS}
SELECT kind, count(*) AS removed FROM up WHERE expires_at <= TIMESTAMP '{AS_OF}' GROUP BY kind""",
    "purge_survivors": f"""WITH {UPLOADS}
SELECT asset_id, principal, kind, byte_count FROM up WHERE expires_at > TIMESTAMP '{AS_OF}'""",
    "retention": f"""WITH {UPLOADS}
SELECT asset_id, CAST(floor(epoch(TIMESTAMP '{AS_OF}' - created_at) / 86400) AS INTEGER) AS age_days
FROM up WHERE floor(epoch(TIMESTAMP '{AS_OF}' - created_at) / 86400) > 1""",
    "orphan_blobs": f"WITH {UPLOADS} SELECT asset_id, principal, byte_count FROM up WHERE event_id % 5 = 0",
    "quota_admission": _admission(),
    "quota_admission_held": _admission(held=True),
    "request_rollup": _rollup(False),
    "rollup_days": """WITH rq AS (
  SELECT ts, '/tools/' || event_type AS path, value AS duration_ms,
         [200, 200, 200, 200, 400, 404, 413, 429, 503, 504][event_id % 10 + 1] AS status
  FROM events
)
SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, path, status, count(*) AS calls,
       avg(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS error_share,
       avg(CASE WHEN status IN (503, 504) THEN 1 ELSE 0 END) AS retryable_share,
       max(duration_ms) AS max_ms, true AS p50_near, true AS p95_near, true AS mean_near
FROM rq GROUP BY 1, 2, 3""",
    "stream_intake": f"WITH {FILES} SELECT path, byte_count, content_type, error_code FROM pg",
    "stream_quota": _admission(),
    "stream_quota_held": _admission(held=True),
    "stream_rollup": _rollup(True),
}
