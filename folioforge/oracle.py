"""DuckDB SQL equal to folioforge.queries, built from expression templates."""

from __future__ import annotations

from folioforge.functions.text import ABBREVIATIONS, CLOSERS, DECIMAL, DOT, ENDS, LANGUAGES, SOFT_BREAKS

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NL = "chr(10)"
_CLOSERS = CLOSERS.replace("'", "''")


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def normalize(x: str) -> str:
    lines = rf"list_transform(string_split(regexp_replace({x}, '\r\n?', {NL}, 'g'), {NL}), lambda s: {strip("regexp_replace(s, '[ \t]+', ' ', 'g')")})"
    return strip(rf"regexp_replace(array_to_string({lines}, {NL}), '\n{{3,}}', {NL} || {NL}, 'g')")


def paragraphs(x: str) -> str:
    return f"list_filter(list_transform(string_split({normalize(x)}, {NL} || {NL}), lambda p: {strip('p')}), lambda p: p <> '')"


def protect(x: str) -> str:
    for short in ABBREVIATIONS:
        x = f"replace({x}, '{short}', '{short.replace('.', DOT)}')"
    for _ in range(2):
        x = rf"regexp_replace({x}, '(\p{{Nd}})\.(\p{{Nd}})', '\1{DECIMAL}\2', 'g')"
    return x


def sentences(x: str) -> str:
    found = f"regexp_extract_all({protect(x)}, '(?s).[^{ENDS}]*(?:[{ENDS}]+[{_CLOSERS}]*|$)')"
    restored = strip(f"replace(replace(s, '{DOT}', '.'), '{DECIMAL}', '.')")
    listed = f"list_filter(list_transform({found}, lambda s: {restored}), lambda s: s <> '')"
    return f"list_transform([{listed}], lambda f: CASE WHEN len(f) = 0 THEN [{strip(x)}] ELSE f END)[1]"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def pack(units: str, limit: int) -> str:
    """units: a column name."""
    first = f"list_transform({units}, lambda u: {{'done': []::VARCHAR[], 'cur': u}})"
    fold = (
        f"list_reduce({first}, lambda a, b: CASE WHEN length(a.cur) + 1 + length(b.cur) > {limit}"
        " THEN {'done': list_append(a.done, a.cur), 'cur': b.cur} ELSE {'done': a.done, 'cur': a.cur || ' ' || b.cur} END)"
    )
    return f"CASE WHEN len({units}) = 0 THEN []::VARCHAR[] ELSE list_transform([{fold}], lambda r: list_append(r.done, r.cur))[1] END"


def split_ctes(source: str, limit: int) -> str:
    """From source(k, s) with long texts s: packed(k, i, q) and parted(k, i, j, u), as oversized sentences are split."""
    soft = rf"string_split(regexp_replace(s, '([{SOFT_BREAKS}]){WS}+', '\1' || chr(1), 'g'), chr(1))"
    parts = f"list_filter(list_transform({soft}, lambda p: {strip('p')}), lambda p: p <> '')"
    return f"""
soft AS (SELECT *, {parts} AS parts FROM {source}),
packs AS (SELECT *, CASE WHEN length(s) <= {limit} OR len(parts) = 1 THEN [s] ELSE {pack("parts", limit)} END AS qs FROM soft),
packed AS (SELECT * EXCLUDE (s, parts, qs), unnest(qs) AS q, generate_subscripts(qs, 1) AS i FROM packs),
{dense_ctes("packed", limit)}"""


def dense_ctes(source: str, limit: int) -> str:
    """From source(..., q): parted(..., u, j), as dense text is split."""
    slices = f"list_transform(range(0, (length(q) - 1) // {limit} + 1), lambda n: substring(q, n * {limit} + 1, {limit}))"
    return f"""
worded AS (SELECT *, {words("q")} AS ws FROM {source}),
dense AS (SELECT *, CASE WHEN length(q) <= {limit} THEN [q] WHEN len(ws) = 1 THEN {slices} ELSE {pack("ws", limit)} END AS us FROM worded),
parted AS (SELECT * EXCLUDE (q, ws, us), unnest(us) AS u, generate_subscripts(us, 1) AS j FROM dense)"""


def segment_ctes(source: str, limit: int) -> str:
    """From source(book_id, chapter_number, text): segments."""
    key = "book_id, chapter_number"
    return f"""
pars AS (SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) AS paragraph_index FROM (SELECT {key}, {paragraphs("text")} AS ps FROM {source})),
sents AS (SELECT {key}, paragraph_index, unnest(ss) AS s, generate_subscripts(ss, 1) AS place FROM (SELECT *, {sentences("p")} AS ss FROM pars)),
{split_ctes("sents", limit)},
units AS (SELECT {key}, paragraph_index, list(u ORDER BY place, i, j) AS us FROM parted GROUP BY ALL),
chunks AS (SELECT {key}, paragraph_index, {pack("us", limit)} AS cs FROM units),
placed AS (SELECT {key}, paragraph_index, {strip("unnest(cs)")} AS text, generate_subscripts(cs, 1) AS n, len(cs) AS of_n FROM chunks),
segments AS (SELECT {key}, row_number() OVER (PARTITION BY {key} ORDER BY paragraph_index, n) AS index, paragraph_index::BIGINT AS paragraph_index,
    text, length(text) AS char_count, n = 1 AS starts_paragraph, n = of_n AS ends_paragraph FROM placed)"""


ID = "printf('chapter_%03d_segment_%04d', chapter_number, index)"
SEGMENT_ROWS = f"SELECT book_id, chapter_number::BIGINT AS chapter_number, {ID} AS segment_id, index, paragraph_index, text, char_count, starts_paragraph, ends_paragraph FROM segments"
DOCUMENTS = "chapters AS (SELECT source AS book_id, doc_id + 1 AS chapter_number, lang AS language, text FROM documents)"
PAGES = "pages_in AS (SELECT 'talks' AS book_id, conv_id + 1 AS chapter_number, turn + 1 AS page_number, text FROM conversations)"
TALKS = f"{PAGES}, chapters AS (SELECT book_id, chapter_number, {strip(f'string_agg(text, {NL} || {NL} ORDER BY page_number, text)')} AS text FROM pages_in GROUP BY ALL)"
ALNUM = "length(regexp_replace({x}, '[^A-Za-z0-9]', '', 'g'))"
_ALNUM_TEXT = ALNUM.format(x="text")
JUDGED = f"""{PAGES}, clean AS (SELECT * REPLACE ({normalize("text")} AS text) FROM pages_in),
judged AS (SELECT *, len({words("text")})::BIGINT AS word_count, {_ALNUM_TEXT} AS alnum_count, len({words("text")}) >= 30 AS kept FROM clean),
usable AS (SELECT * EXCLUDE (any_kept) FROM (SELECT *, bool_or(kept AND text <> '') OVER (PARTITION BY book_id, chapter_number) AS any_kept FROM judged)
    WHERE text <> '' AND (kept OR NOT any_kept))"""

_INDEX = "turn + 1"
SEG = f"""seg AS (SELECT 'talks' AS book_id, conv_id + 1 AS chapter_number, turn + 1 AS index, text, length(text) AS char_count, turn % 2 = 0 AS ends_paragraph,
    printf('chapter_%03d_segment_%04d', conv_id + 1, turn + 1) AS segment_id,
    printf('segments/talks/chapter_%03d/chapter_%03d_segment_%04d.wav', conv_id + 1, conv_id + 1, turn + 1) AS path FROM conversations)"""
STATE = f"""{SEG}, st AS (SELECT *, CASE (chapter_number + index) % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'pending' END AS status,
    CASE WHEN (chapter_number + index) % 5 <> 0 THEN path END AS audio_path, index % 4 AS attempts,
    CASE WHEN (chapter_number + index) % 3 = 1 THEN 'earlier failure' END AS error FROM seg),
files AS (SELECT path FROM seg WHERE (3 * chapter_number + 7 * index) % 4 < 2),
seen AS (SELECT *, coalesce(audio_path IN (SELECT path FROM files), false) AS present FROM st)"""
RESUMED = "CASE WHEN status = 'completed' AND NOT present THEN 'pending' WHEN status = 'failed' AND present THEN 'completed' ELSE status END"
FRAMES = "trunc(1000::DOUBLE * ({ms}::DOUBLE / 1000.0::DOUBLE))::BIGINT"
_BETWEEN, _PARAGRAPH, _PREFIX, _SUFFIX = (FRAMES.format(ms=ms) for ms in (251, 500, 401, 800))
TIMED = f"""{SEG}, paused AS (SELECT *, char_count * 3 AS frames, CASE WHEN lead(index) OVER o IS NULL THEN 0 WHEN ends_paragraph THEN {_PARAGRAPH} ELSE {_BETWEEN} END AS pause_frames
    FROM seg WINDOW o AS (PARTITION BY chapter_number ORDER BY index))"""
QUANTIZED = "array_to_string(list_transform({x}, lambda v: trunc(greatest(-1::FLOAT, least(1::FLOAT, v)) * 32767::FLOAT)::BIGINT), ',')"
MILLI = "array_to_string(list_transform({x}, lambda v: round({v} * 1000)::BIGINT), ',')"
DIRTY = r"replace(replace(replace(replace(text, '. ', '.' || chr(13) || chr(10) || chr(9) || chr(13) || chr(10) || ' ' || chr(10) || chr(10)), ', ', ',' || chr(9) || chr(160) || ' '), ' de ', chr(12) || ' de' || chr(8195) || ' '), ' the ', ' ' || chr(28) || chr(13) || 'the ')"
SUFFIXED = "url || ['.txt', '.TEXT', '.md', '.Pdf', '.docx'][(page_id % 5 + 1)::INT]"
_ATTEMPTS = f"""{STATE}, tries AS (SELECT *, unnest(CASE WHEN contains(text, '?') THEN range(attempts + 1, 4) WHEN attempts < 3 THEN [attempts + 1] ELSE [] END) AS attempt FROM st)"""
_LABELS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in sorted(LANGUAGES.items())) + "}"
_CODES = ", ".join(f"'{k}'" for k in sorted(LANGUAGES))
_LANGUAGE = strip("CASE WHEN doc_id % 7 = 0 THEN 'xx' ELSE ' ' || upper(lang) || chr(9) END")
_VOICE = "flatten(list_transform(range(vec_id % 17), lambda n: embedding::FLOAT[]))"

SQL: dict[str, str] = {
    "normalize_text": f"SELECT doc_id, {normalize(DIRTY)} AS normalized FROM documents",
    "paragraphs": f"WITH {TALKS} SELECT book_id, chapter_number, unnest(ps) AS text, generate_subscripts(ps, 1) AS paragraph_index FROM (SELECT book_id, chapter_number, {paragraphs('text')} AS ps FROM chapters)",
    "sentences": f"SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS place FROM (SELECT doc_id, {sentences('t')} AS ss FROM (SELECT doc_id, {strip('text')} AS t FROM documents))",
    "dense_split": f"WITH src AS (SELECT doc_id, text AS q FROM documents), {dense_ctes('src', 40)} SELECT doc_id, j - 1 AS place, u AS part FROM parted",
    "oversized_split": f"WITH src AS (SELECT doc_id, {strip('text')} AS s FROM documents), {split_ctes('src', 120)} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS place, u AS part FROM parted",
    "chunk_documents": f"WITH {DOCUMENTS}, {segment_ctes('chapters', 500)} {SEGMENT_ROWS}",
    "chunk_conversations": f"WITH {TALKS}, {segment_ctes('chapters', 120)} {SEGMENT_ROWS}",
    "word_alnum_counts": f"SELECT doc_id, len({words('text')})::BIGINT AS word_count, {_ALNUM_TEXT} AS alnum_count FROM documents",
    "extraction_route": f"SELECT doc_id, CASE WHEN {_ALNUM_TEXT} >= 800 THEN 'direct' ELSE 'ocr' END AS route FROM documents",
    "page_keep": f"WITH {JUDGED} SELECT * FROM judged",
    "page_fallback": f"WITH {JUDGED} SELECT book_id, chapter_number, page_number, kept FROM usable",
    "page_combine": f"WITH {JUDGED} SELECT book_id, chapter_number, {strip(f'string_agg(text, {NL} || {NL} ORDER BY page_number, text)')} AS text FROM usable GROUP BY ALL",
    "page_counts": f"WITH {JUDGED} SELECT book_id, chapter_number, count(*) FILTER (kept) AS kept_pages, count(*) FILTER (NOT kept) AS skipped_pages FROM judged GROUP BY ALL",
    "language_check": f"SELECT doc_id, lower({_LANGUAGE}) AS language, CASE WHEN lower({_LANGUAGE}) IN ({_CODES}) THEN '' ELSE 'unsupported_language' END AS violations FROM documents",
    "language_labels": f"SELECT lang, {_LABELS}[lang] AS label, count(*) AS chapters FROM documents GROUP BY ALL",
    "identifier_sanitize": rf"""WITH v AS (SELECT page_id AS id, 'page' AS kind, url AS value FROM pages UNION ALL SELECT c_custkey, 'customer', ' --' || c_name || '!? ' FROM customer)
        SELECT id, kind, lower(regexp_replace(regexp_replace({strip("value")}, '[^a-zA-Z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g')) AS identifier FROM v""",
    "source_hash": "SELECT doc_id, sha256(text) AS source_text_hash FROM documents",
    "output_paths": """SELECT doc_id + 1 AS chapter_number, printf('manifests/%s_chapter_%03d.json', source, doc_id + 1) AS manifest_path,
        printf('segments/%s/chapter_%03d/chapter_%03d_segment_0007.wav', source, doc_id + 1, doc_id + 1) AS segment_path,
        printf('chapters/%s/%s_chapter_%03d.wav', source, source, doc_id + 1) AS chapter_path,
        printf('logs/%s_chapter_%03d_20240203T040506Z.log', source, doc_id + 1) AS log_path FROM documents""",
    "suffix_dispatch": rf"""WITH s AS (SELECT page_id, lower({SUFFIXED}) AS p FROM pages) SELECT page_id,
        CASE WHEN regexp_matches(p, '[^/]\.(txt|text|md)$') THEN 'text' WHEN regexp_matches(p, '[^/]\.pdf$') THEN 'pdf' END AS source_kind,
        CASE WHEN regexp_matches(p, '\.pdf$') THEN 'pdf' ELSE 'text' END AS input_kind FROM s""",
    "manifest_build": f"""WITH {DOCUMENTS}, {segment_ctes('chapters', 500)}, m AS (SELECT book_id, chapter_number, count(*) AS n, string_agg({ID}, ',' ORDER BY index) AS ids FROM segments GROUP BY ALL)
        SELECT book_id, chapter_number, language, sha256(text) AS source_text_hash, coalesce(n, 0) AS n_segments, coalesce(ids, '') AS ids FROM chapters LEFT JOIN m USING (book_id, chapter_number)""",
    "manifest_json": f"""WITH {DOCUMENTS}, {segment_ctes('chapters', 500)}, m AS (SELECT book_id, chapter_number, count(*) AS n, string_agg(text, {NL} ORDER BY index) AS t FROM segments GROUP BY ALL)
        SELECT book_id, chapter_number, coalesce(n, 0) AS n_segments, sha256(coalesce(t, '')) AS texts_sha256, 'my-book' AS config_book, CASE WHEN n IS NULL THEN '' ELSE 'pending' END AS statuses FROM chapters LEFT JOIN m USING (book_id, chapter_number)""",
    "config_manifest": """SELECT * FROM (VALUES ('git', 'url', 'https://example.org/r.git'), ('git', 'branch', 'main'), ('git', 'directory', 'workspace'), ('git', 'private', 'false'),
        ('chapter', 'book_id', 'my-book'), ('chapter', 'chapter_number', '3'), ('chapter', 'chapter_file', 'chapter.txt'), ('chapter', 'source_language', 'en'), ('chapter', 'target_language', 'fr'),
        ('generation', 'voice_file', 'null'), ('generation', 'minimum_chunk_characters', '200'), ('generation', 'maximum_chunk_characters', '500'), ('generation', 'exaggeration', '0.5'),
        ('generation', 'cfg_weight', '0.5'), ('generation', 'temperature', '0.8'), ('generation', 'maximum_retries', '3'), ('generation', 'force_regeneration', 'false'),
        ('generation', 'allow_cpu_fallback', 'false'), ('generation', 'partial_export', 'false'),
        ('silence', 'between_segments_ms', '250'), ('silence', 'between_paragraphs_ms', '500'), ('silence', 'chapter_prefix_ms', '400'), ('silence', 'chapter_suffix_ms', '800'),
        ('export', 'export_mp3', 'true'), ('export', 'export_m4b', 'false'), ('export', 'mp3_bitrate', '192k'), ('export', 'm4b_bitrate', '96k'), ('export', 'normalize_peak', '0.98'),
        ('paths', 'root', '/out'), ('paths', 'books_dir', '/out/books'), ('paths', 'voices_dir', '/out/voices'), ('paths', 'segments_dir', '/out/segments'), ('paths', 'chapters_dir', '/out/chapters'),
        ('paths', 'manifests_dir', '/out/manifests'), ('paths', 'logs_dir', '/out/logs'), ('t3_model', '', 'v3')) v(block, name, value)""",
    "layout_check": f"""WITH {SEG} SELECT book_id, chapter_number, segment_id, CASE WHEN (chapter_number + index) % 11 = 0 THEN 'missing' ELSE 'changed' END AS difference
        FROM seg WHERE (chapter_number + index) % 11 = 0 OR index % 3 = 0""",
    "resume_state": f"""WITH {STATE} SELECT chapter_number, segment_id, {RESUMED} AS status, attempts, CASE WHEN status = 'completed' AND NOT present
        THEN 'Completed audio file was missing during resume.' WHEN status = 'failed' AND present THEN NULL ELSE error END AS error FROM seen""",
    "resume_forced": f"WITH {STATE} SELECT chapter_number, segment_id, 'pending' AS status, 0::BIGINT AS attempts, NULL::VARCHAR AS error FROM seen",
    "prepare_state": f"WITH {STATE} SELECT chapter_number, segment_id, CASE WHEN chapter_number % 2 = 1 THEN {RESUMED} ELSE 'pending' END AS status, CASE WHEN chapter_number % 2 = 1 THEN attempts ELSE 0 END AS attempts FROM seen",
    "prepare_chapters": f"""WITH {STATE}, v AS (SELECT chapter_number, CASE WHEN chapter_number % 5 = 0 THEN 'text_changed'
        WHEN chapter_number % 11 = 0 AND bool_or(index = 1) OR chapter_number % 7 = 0 AND bool_or(index = 2) THEN 'layout_changed' END AS violation FROM st WHERE chapter_number % 3 <> 0 GROUP BY chapter_number)
        SELECT chapter_number, segment_id, CASE WHEN chapter_number % 3 = 0 THEN 'pending' WHEN violation IS NULL THEN {RESUMED} ELSE status END AS status,
        CASE WHEN chapter_number % 3 = 0 THEN 0 ELSE attempts END AS attempts, violation FROM seen LEFT JOIN v USING (chapter_number)
        WHERE chapter_number % 3 = 0 OR chapter_number % 7 <> 0 OR index <> 2""",
    "pending_work": f"WITH {STATE} SELECT chapter_number, segment_id, status FROM st WHERE NOT (status = 'completed' AND coalesce(audio_path, path) IN (SELECT path FROM files))",
    "render_selection": f"""WITH {STATE}, u AS (SELECT *, status = 'completed' AND present AS usable FROM seen)
        SELECT chapter_number, coalesce(string_agg(segment_id, ',' ORDER BY index) FILTER (usable), '') AS used_ids,
        coalesce(string_agg(segment_id, ',' ORDER BY index) FILTER (NOT usable), '') AS failed_ids,
        CASE WHEN count(*) FILTER (usable) = 0 THEN 'empty' END AS fault FROM u GROUP BY chapter_number""",
    "status_summary": f"""WITH {STATE} SELECT book_id, chapter_number, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
        count(*) FILTER (status = 'pending') AS other FROM st GROUP BY ALL""",
    "first_failed": f"WITH {STATE} SELECT chapter_number, segment_id, row_number() OVER (PARTITION BY chapter_number ORDER BY index) AS place FROM st WHERE status = 'failed' QUALIFY place <= 2",
    "resume_summary": f"WITH {STATE} SELECT book_id, chapter_number, count(*) FILTER (status = 'completed' AND present) AS ready, count(*) FILTER (status <> 'completed') AS not_completed, coalesce(string_agg(segment_id, ',' ORDER BY index) FILTER (status <> 'completed'), '') AS open_ids FROM seen GROUP BY ALL",
    "segment_lookup": f"WITH {SEG} SELECT chapter_number, segment_id, text FROM seg",
    "retry_ledger": f"""WITH {_ATTEMPTS} SELECT chapter_number, segment_id, attempt, CASE WHEN contains(text, '?') THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN contains(text, '?') THEN 'a question was refused' END AS error, CASE WHEN contains(text, '?') THEN 0 ELSE 2400 END::BIGINT AS n_samples FROM tries""",
    "event_snapshot": f"""WITH {_ATTEMPTS} SELECT chapter_number, segment_id, max(attempt) AS attempt, CASE WHEN contains(any_value(text), '?') THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN NOT contains(any_value(text), '?') THEN 0.1::DOUBLE END AS duration_seconds FROM tries GROUP BY chapter_number, segment_id""",
    "silence_timeline": f"""WITH {TIMED} SELECT chapter_number, segment_id, frames, pause_frames,
        (coalesce(sum(frames + pause_frames) OVER (PARTITION BY chapter_number ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + {_PREFIX})::BIGINT AS start_frame FROM paused""",
    "chapter_duration": f"""WITH {TIMED}, w AS (SELECT book_id, chapter_number, (sum(frames + pause_frames) + {_PREFIX} + {_SUFFIX})::BIGINT AS frames FROM paused GROUP BY ALL)
        SELECT book_id, chapter_number, 1000::BIGINT AS sample_rate, frames, frames / 1000 AS duration_seconds FROM w""",
    "chapter_assembly": f"""WITH {SEG}, s AS (SELECT chapter_number, index, ends_paragraph, char_count, CASE WHEN chapter_number % 7 = 0 AND index = 2 THEN 2000 ELSE 1000 END AS rate,
        list_transform(range(1, char_count + 1), lambda n: (((n * 7 + chapter_number * 13 + index * 31) % 201 - 100) / 400.0::DOUBLE)::FLOAT) AS x FROM seg),
        c AS (SELECT chapter_number, CASE WHEN min(rate) <> max(rate) THEN 'sample_rate' END AS fault, coalesce(max(list_max(list_transform(x, lambda v: abs(v)))), 0)::DOUBLE AS top FROM s GROUP BY ALL),
        p AS (SELECT *, lag(index) OVER o IS NULL AS is_first, CASE WHEN lead(index) OVER o IS NULL THEN {_SUFFIX} WHEN ends_paragraph THEN {_PARAGRAPH} ELSE {_BETWEEN} END AS quiet
        FROM s JOIN c USING (chapter_number) WINDOW o AS (PARTITION BY chapter_number ORDER BY index)),
        q AS (SELECT *, (coalesce(sum(char_count + quiet) OVER (PARTITION BY chapter_number ORDER BY index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN is_first THEN 0 ELSE {_PREFIX} END)::BIGINT AS start_frame,
        list_transform(range(CASE WHEN is_first THEN {_PREFIX} ELSE 0 END), lambda n: 0::FLOAT) || list_transform(x, lambda v: CASE WHEN top > 0 THEN (v::DOUBLE * least(0.9::DOUBLE / top, 1.0::DOUBLE / top))::FLOAT ELSE v END)
        || list_transform(range(quiet), lambda n: 0::FLOAT) AS y FROM p)
        SELECT chapter_number, index, CASE WHEN fault IS NULL THEN start_frame END AS start_frame, CASE WHEN fault IS NULL THEN len(y) END::BIGINT AS frames,
        CASE WHEN fault IS NULL THEN sha256({QUANTIZED.format(x="y")}) END AS pcm_sha256, fault FROM q""",
    "audio_validate": "SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'silent' WHEN 2 THEN 'not_finite' END AS fault FROM embeddings",
    "pcm_quantize": f"SELECT vec_id, {QUANTIZED.format(x='list_transform(embedding::FLOAT[], lambda e: (e * 3::FLOAT)::FLOAT)')} AS pcm FROM embeddings",
    "pcm_roundtrip": f"""SELECT vec_id, {QUANTIZED.format(x="list_transform(embedding::FLOAT[], lambda e: (trunc(greatest(-1::FLOAT, least(1::FLOAT, e)) * 32767::FLOAT)::FLOAT / 32767::FLOAT)::FLOAT)")} AS pcm FROM embeddings""",
    "peak_normalize": f"""WITH p AS (SELECT label, max(list_max(list_transform(embedding::FLOAT[], lambda e: abs(e))))::DOUBLE AS top FROM embeddings GROUP BY label)
        SELECT vec_id, label::BIGINT + 1 AS chapter_number, {MILLI.format(x="list_transform(embedding::FLOAT[], lambda e: (e::DOUBLE * least(0.9::DOUBLE / top, 1.0::DOUBLE / top))::FLOAT)", v="v::DOUBLE")} AS milli
        FROM embeddings JOIN p USING (label)""",
    "layout_uniformity": f"""WITH {SEG} SELECT chapter_number, CASE WHEN chapter_number % 3 = 0 AND bool_or(index = 2) AND count(*) > 1 THEN 'sample_rate'
        WHEN chapter_number % 5 = 0 AND bool_or(index = 1) AND count(*) > 1 THEN 'channels' END AS fault FROM seg GROUP BY chapter_number""",
    "voice_check": f"""WITH v AS (SELECT vec_id, {_VOICE} AS s FROM embeddings), d AS (SELECT vec_id, s, coalesce(len(s), 0) / 16 AS duration_seconds FROM v)
        SELECT vec_id, duration_seconds, CASE WHEN duration_seconds < 3 THEN 'too_short' WHEN duration_seconds > 60 THEN 'too_long' END AS fault,
        CASE WHEN duration_seconds < 10 OR duration_seconds > 20 THEN 'duration_outside_10_to_20_seconds' ELSE '' END AS warnings FROM d""",
    "channel_mean": f"""WITH m AS (SELECT vec_id, list_transform(range(0, len(embedding) // 2), lambda n: ((embedding[(2 * n + 1)::INT]::DOUBLE + embedding[(2 * n + 2)::INT]::DOUBLE) / 2)::FLOAT) AS x FROM embeddings)
        SELECT vec_id, len(x)::BIGINT AS frames, {MILLI.format(x="x", v="v::DOUBLE")} AS milli FROM m""",
    "frame_shapes": """SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'length' END AS fault, CASE WHEN vec_id % 5 <> 0 THEN len(embedding) // 2 END::BIGINT AS frames,
        CASE WHEN vec_id % 5 <> 0 THEN round(embedding[3]::DOUBLE * 1000)::BIGINT END AS second_frame_milli FROM embeddings""",
    "pdf_chapters": f"""WITH {TALKS}, clean AS (SELECT * REPLACE ({normalize("text")} AS text) FROM pages_in), judged AS (SELECT *, len({words("text")}) >= 12 AS kept FROM clean),
        usable AS (SELECT * FROM (SELECT *, bool_or(kept AND text <> '') OVER (PARTITION BY chapter_number) AS any_kept FROM judged) WHERE text <> '' AND (kept OR NOT any_kept)),
        ocr AS (SELECT chapter_number, {strip(f'string_agg(text, {NL} || {NL} ORDER BY page_number, text)')} AS whole FROM usable GROUP BY ALL)
        SELECT chapter_number, {_ALNUM_TEXT} < 800 AS used_ocr, CASE WHEN {_ALNUM_TEXT} >= 800 THEN text ELSE coalesce(whole, '') END AS text FROM chapters LEFT JOIN ocr USING (chapter_number)""",
    "ffmpeg_command": """WITH w AS (SELECT doc_id + 1 AS chapter_number, printf('chapters/%s/%s_chapter_%03d.', source, source, doc_id + 1) AS stem FROM documents)
        SELECT chapter_number, 'mp3' AS kind, 'ffmpeg -y -i ' || stem || 'wav -vn -c:a libmp3lame -b:a 192k ' || stem || 'mp3' AS command FROM w
        UNION ALL SELECT chapter_number, 'm4b', 'ffmpeg -y -i ' || stem || 'wav -vn -c:a aac -b:a 96k -movflags +faststart -f mp4 ' || stem || 'm4b' FROM w""",
    "wav_roundtrip": f"""SELECT vec_id, {QUANTIZED.format(x="list_transform(embedding::FLOAT[], lambda e: (trunc(greatest(-1::FLOAT, least(1::FLOAT, e)) * 32767::FLOAT)::FLOAT / 32767::FLOAT)::FLOAT)")} AS pcm FROM embeddings""",
    "fake_synthesis": f"WITH {SEG} SELECT chapter_number, segment_id, 'completed' AS status, 2400::BIGINT AS n_samples, 0.1::DOUBLE AS duration_seconds, NULL::VARCHAR AS fault FROM seg",
}
