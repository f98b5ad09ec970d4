"""The same results in plain SQL (DuckDB), computed from the tables alone.

The symbols of the generated code are known from the columns they are made of,
so the SQL does not parse anything.
"""

from __future__ import annotations

from treelens.functions.prompts import INSTRUCTION, SYSTEM_MESSAGE
from treelens.plans.views import ANSWER, CODE, CODE_PATH, DOC_PATH

EMPTY_HASH = "sha256('')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(text: str) -> str:
    """A text literal with its newlines spelled as chr(10)."""
    return "concat(" + ", chr(10), ".join(_quoted(part) for part in text.split("\n")) + ")"


PATH_PARTS = """
    CASE WHEN path LIKE '%/%' THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir,
    string_split(path, '/')[-1] AS name,
    CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth"""

DOCS = f"docs AS (SELECT 'docs' AS root, {DOC_PATH} AS path, text AS content FROM documents)"
PAGES = """web_ranked AS (
    SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(
        url, '^https?://', ''), '[?#].*$', ''), '/$', '') AS path FROM pages),
web AS (SELECT 'web' AS root, CASE WHEN row_number() OVER (PARTITION BY path ORDER BY page_id) = 1
    THEN path ELSE concat(path, '~', page_id) END AS path, html AS content FROM web_ranked)"""
CODE_FILES = f"code AS (SELECT 'code' AS root, {CODE_PATH} AS path, {CODE} AS content FROM part)"
ALL = f"""{DOCS}, {PAGES}, {CODE_FILES},
corpus AS (SELECT * FROM docs UNION ALL SELECT * FROM web UNION ALL SELECT * FROM code)"""


def _hashed(corpus: str) -> str:
    return f"""hashed AS (SELECT root, path, {PATH_PARTS},
    strlen(content) AS size_bytes, sha256(content) AS content_hash FROM {corpus})"""


DIRS = """dirs AS (SELECT root, dir, count(*) AS file_count,
    CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
    sha256(string_agg(content_hash, '|' ORDER BY name)) AS content_hash
    FROM hashed GROUP BY root, dir)"""

RECORDS = f"""records AS (
    SELECT 'code' AS root, path, {PATH_PARTS}, strlen(content) AS size_bytes,
        sha256(content) AS content_hash,
        CASE WHEN ok THEN p_name END AS module_docstring,
        CASE WHEN ok THEN ['f_' || p_partkey] ELSE [] END AS functions,
        CASE WHEN ok THEN ['C_' || replace(p_brand, 'Brand#', '')] ELSE [] END AS classes,
        CASE WHEN ok THEN ['m_' || p_size, 'r_' || (p_size % 3), 'n_' || (p_partkey % 7)]
            ELSE [] END AS imports,
        CASE WHEN NOT ok THEN 'SyntaxError' END AS parse_error
    FROM (SELECT *, {CODE_PATH} AS path, {CODE} AS content, p_partkey % 10 <> 9 AS ok FROM part))"""

SYMBOLS = """symbols AS (
    SELECT root, path, dir, name, kind, unnest(items) AS symbol,
        CAST(generate_subscripts(items, 1) - 1 AS INTEGER) AS ordinal
    FROM (SELECT root, path, dir, name, 'function' AS kind, functions AS items FROM records
        UNION ALL SELECT root, path, dir, name, 'class', classes FROM records
        UNION ALL SELECT root, path, dir, name, 'import', imports FROM records))"""

UNIONS = """unions AS (
    SELECT root, dir, kind, symbol, first.name AS first_file, first.ordinal AS first_ordinal
    FROM (SELECT root, dir, kind, symbol, min({'name': name, 'ordinal': ordinal}) AS first
        FROM symbols GROUP BY root, dir, kind, symbol))"""

# Directory records of the code corpus, the root included.
CODE_DIRS = f"""{RECORDS}, {SYMBOLS}, {UNIONS},
ranked AS (SELECT root, dir, file_count, total_size_bytes, content_hash FROM (
    SELECT root, dir, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes,
        sha256(string_agg(content_hash, '|' ORDER BY name)) AS content_hash
    FROM records GROUP BY root, dir)
    UNION ALL SELECT 'code', '', 0, 0, {EMPTY_HASH}),
children AS (SELECT 'code' AS root, '' AS dir,
    list(DISTINCT string_split(dir, '/')[1]) AS names FROM records),
folded AS (SELECT root, dir, kind, list(symbol ORDER BY first_file, first_ordinal) AS items
    FROM unions GROUP BY root, dir, kind),
dirs AS (SELECT r.*,
    CASE WHEN dir = '' THEN root ELSE root || '/' || dir END AS path,
    CASE WHEN dir = '' THEN root ELSE string_split(dir, '/')[-1] END AS dir_name,
    coalesce((SELECT list_sort(names) FROM children c WHERE c.dir = r.dir), []) AS subdirectories,
    coalesce((SELECT items FROM folded f WHERE f.dir = r.dir AND kind = 'function'), [])
        AS all_functions,
    coalesce((SELECT items FROM folded f WHERE f.dir = r.dir AND kind = 'class'), [])
        AS all_classes,
    coalesce((SELECT items FROM folded f WHERE f.dir = r.dir AND kind = 'import'), [])
        AS all_imports
    FROM ranked r),
summarized AS (SELECT *,
    concat('Directory ''', dir_name, ''' holds ', file_count, ' source file(s).') AS overview,
    list_slice(list_concat(list_slice(all_functions, 1, 10), list_slice(all_classes, 1, 10)), 1, 10)
        AS key_symbols
    FROM dirs)"""


def _ticked(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: '`' || x || '`'), ', ')"


def _bullets(items: str, before: str = "`", after: str = "`") -> str:
    return (
        f"coalesce(array_to_string(list_transform({items}, "
        f"lambda x: concat('- {before}', x, '{after}', chr(10))), ''), '')"
    )


def _labelled(label: str, items: str) -> str:
    return (
        f"CASE WHEN len({items}) > 0 THEN concat(chr(10), '**{label}:** ', {_ticked(items)}, "
        "chr(10)) ELSE '' END"
    )


_RULE = "chr(10), '---', chr(10), chr(10), "


def _markdown(table: str, overview: str, key_symbols: str) -> str:
    """Documents of all directories, one expression per section."""
    rows = (
        "string_agg(concat('| `', name, '` | ', size_bytes, ' B | ', "
        "CASE WHEN len(functions) > 0 THEN array_to_string(functions, ', ') ELSE '—' END, ' | ', "
        "CASE WHEN len(classes) > 0 THEN array_to_string(classes, ', ') ELSE '—' END, ' |', "
        "chr(10)), '' ORDER BY name)"
    )
    details = (
        "string_agg(concat(chr(10), '#### `', name, '`', chr(10), chr(10), "
        "coalesce(module_docstring, '*No module docstring.*'), chr(10), "
        f"{_labelled('Functions', 'functions')}, {_labelled('Classes', 'classes')}, "
        f"{_labelled('Imports', 'imports')}), '' ORDER BY name)"
    )
    everything = (
        "CASE WHEN len(all_functions) + len(all_classes) = 0 "
        "THEN concat('*No symbols found.*', chr(10)) "
        "ELSE concat('*No key symbols summarised; all extracted symbols:*', chr(10), "
        f"{_labelled('Functions', 'all_functions')}, {_labelled('Classes', 'all_classes')}) END"
    )
    return f"""{CODE_DIRS},
    parts AS (SELECT dir, {rows} AS file_rows, {details} AS file_details
        FROM records GROUP BY dir),
    documents_ AS (SELECT d.root, d.dir, content_hash, concat(
        '<!-- content-hash: ', content_hash, ' -->', chr(10),
        '# Context: ', dir_name, chr(10), chr(10),
        '> Generated on 2024-01-01T00:00:00Z  ', chr(10), '> Directory: `', path, '`', chr(10),
        {_RULE} '## Overview', chr(10), chr(10), {overview}, chr(10),
        {_RULE} '## Source Files', chr(10), chr(10),
        CASE WHEN file_count > 0 THEN concat(
            '| File | Size | Functions | Classes |', chr(10),
            '|------|------|-----------|---------|', chr(10), file_rows,
            chr(10), '### File Details', chr(10), file_details)
        ELSE concat('*No source files directly in this directory.*', chr(10)) END,
        {_RULE} '## Key Symbols', chr(10), chr(10),
        CASE WHEN len({key_symbols}) > 0 THEN {_bullets(key_symbols)} ELSE {everything} END,
        {_RULE} '## Dependencies', chr(10), chr(10),
        CASE WHEN len(all_imports) > 0 THEN {_bullets('all_imports')}
            ELSE concat('*No imports detected.*', chr(10)) END,
        {_RULE} '## Non-Obvious Patterns', chr(10), chr(10), '*No patterns identified.*', chr(10),
        {_RULE} '## Tribal Knowledge', chr(10), chr(10), '*No tribal knowledge recorded.*', chr(10),
        {_RULE} '## Subdirectories', chr(10), chr(10),
        CASE WHEN len(subdirectories) > 0 THEN array_to_string(list_transform(subdirectories,
            lambda x: concat('- [`', x, '/`](', x, '/CONTEXT.md)', chr(10))), '')
        ELSE concat('*No subdirectories.*', chr(10)) END,
        {_RULE} '*Content hash: `', content_hash, '`*', chr(10)) AS markdown
        FROM {table} d LEFT JOIN parts p ON p.dir = d.dir)"""


WITH_SUMMARY = _markdown("summarized", "overview", "key_symbols")
NO_SUMMARY = _markdown("dirs", "'*No summary available for this directory.*'", "[]")

PROMPTS = f"""{CODE_DIRS},
blocks AS (SELECT dir, string_agg(concat(
    '- ', name, ' (', size_bytes, ' bytes)', chr(10),
    '  docstring: ', coalesce(module_docstring, '(no docstring)'), chr(10),
    '  functions: ', CASE WHEN len(functions) > 0 THEN array_to_string(functions, ', ')
        ELSE 'none' END, chr(10),
    '  classes: ', CASE WHEN len(classes) > 0 THEN array_to_string(classes, ', ')
        ELSE 'none' END, chr(10),
    '  imports: ', CASE WHEN len(imports) > 0 THEN array_to_string(imports, ', ')
        ELSE 'none' END, chr(10)), '' ORDER BY name) AS text FROM records GROUP BY dir),
prompts AS (SELECT root, d.dir, path, concat('Describe this source directory.', chr(10), chr(10),
    'Directory: ', path, chr(10), 'Subdirectories: ',
    CASE WHEN len(subdirectories) > 0
        THEN array_to_string(list_slice(subdirectories, 1, 20), ', ') ELSE '(none)' END,
    chr(10), chr(10), 'Source files:', chr(10),
    coalesce(text, concat('(no source files in this directory)', chr(10))),
    {_lines(INSTRUCTION)}) AS prompt
    FROM dirs d LEFT JOIN blocks b ON b.dir = d.dir)"""

MANIFEST = """stored AS (
    SELECT root, dir,
        CASE WHEN total_size_bytes % 11 = 0 THEN 'old'
            WHEN total_size_bytes % 7 = 0 THEN reverse(content_hash)
            ELSE content_hash END AS stored_hash,
        CASE WHEN total_size_bytes % 11 <> 0 AND total_size_bytes % 3 = 0 THEN 'failed'
            ELSE 'ok' END AS stored_status
    FROM dirs WHERE total_size_bytes % 11 = 0 OR total_size_bytes % 5 <> 0)"""


def _changed(condition: str) -> str:
    return f"""WITH {ALL}, {_hashed('corpus')}, {DIRS}, {MANIFEST}
    SELECT d.root, d.dir, content_hash, {condition} AS changed
    FROM dirs d LEFT JOIN stored s ON s.root = d.root AND s.dir = d.dir"""


_DIFFERS = "coalesce(stored_hash <> content_hash, true)"

ORACLE: dict[str, str] = {
    "corpus_from_table": f"""WITH {DOCS}
    SELECT root, path, strlen(content) AS size_bytes FROM docs""",
    "scan_tree": f"""WITH {CODE_FILES}
    SELECT path, strlen(content) AS length, sha256(content) AS content_hash FROM code""",
    "scan_rejects": f"""WITH {CODE_FILES}
    SELECT path, strlen(content) AS length, 'larger than 130 bytes' AS read_error
    FROM code WHERE strlen(content) > 130""",
    "scan_unreadable": f"""WITH {CODE_FILES},
    seen AS (SELECT *, path LIKE 'brand_7/%/p_%1.py' AS gone FROM code)
    SELECT path, CASE WHEN NOT gone THEN strlen(content) END AS size_bytes,
        CASE WHEN NOT gone THEN sha256(content) END AS content_hash,
        CASE WHEN gone THEN '[Errno 2] No such file or directory' END AS read_error FROM seen""",
    "stored_hash_parse": """SELECT doc_id,
    CASE WHEN doc_id % 5 < 2 THEN sha256(text) END AS stored_hash FROM documents""",
    "suffix_filter": f"""WITH {PAGES}, named AS (SELECT path, {PATH_PARTS} FROM web)
    SELECT path, CASE WHEN length(path) % 2 = 0 THEN upper(name) ELSE name END AS name
    FROM named WHERE lower(name) LIKE '%_.html'""",
    "ignore_filter": f"""WITH {PAGES} SELECT path, CASE
    WHEN regexp_full_match(path, '(.+/)?spam-[^/]*(/.*)?') THEN true
    WHEN regexp_full_match(path, 'm\\.[^/]*/(.+/)?1[^/](/.*)?') THEN false
    WHEN regexp_full_match(path, '(.+/)?fr/6[^/]*(/.*)?') THEN true
    WHEN regexp_full_match(path, 'www\\.[^/]*/de(/.*)?') THEN true
    WHEN regexp_full_match(path, 'blog\\.[^/]*/es/.*') THEN true
    WHEN regexp_full_match(path, '(.+/)?[^/]*\\.html(/.*)?') THEN true
    ELSE false END AS ignored FROM web""",
    "ignore_prune": f"""WITH {PAGES}, named AS (SELECT path, {PATH_PARTS} FROM web),
    judged AS (SELECT path,
        path LIKE 'blog.%' OR dir LIKE '%/fr' OR regexp_full_match(dir, 'm\\..*/es') AS pruned,
        CASE WHEN regexp_full_match(path, '(.+/)?[^/]*\\.html') THEN true
            WHEN regexp_full_match(path, 'm\\.[^/]*/en/.*') THEN false
            WHEN regexp_full_match(path, 'm\\.[^/]*/e[ns]/.*') THEN true
            WHEN regexp_full_match(path, 'blog\\.[^/]*/fr/7[^/]*') THEN false
            WHEN regexp_full_match(path, '(.+/)?fr/.*') THEN true
            WHEN regexp_full_match(path, '(.+/)?blog\\.[^/]*/.*') THEN true
            ELSE false END AS ignored
        FROM named)
    SELECT path, pruned, NOT pruned AND NOT ignored AS walked FROM judged""",
    "depth_filter": f"""WITH {PAGES}, flat AS (SELECT CASE WHEN length(path) % 3 = 0
        THEN replace(path, '/', '-') ELSE path END AS path FROM web),
    named AS (SELECT path, {PATH_PARTS} FROM flat)
    SELECT path, depth FROM named WHERE depth <= 1""",
    "ignore_by_name": f"""WITH {PAGES}, named AS (SELECT path, {PATH_PARTS} FROM web)
    SELECT path FROM named WHERE NOT CASE
        WHEN name LIKE '3%' THEN true
        WHEN regexp_full_match(name, '[^0-8][^/]') THEN true
        WHEN name LIKE '77%' THEN false
        WHEN name LIKE '7%' THEN true
        WHEN name LIKE '%5.html' THEN true
        ELSE false END""",
    "record_flags": f"""WITH {RECORDS} SELECT path,
    CAST(len(functions) + len(classes) AS INTEGER) AS symbol_count,
    module_docstring IS NULL AND len(functions) + len(classes) = 0 AS is_empty FROM records""",
    "preview_one": f"""WITH {WITH_SUMMARY}
    SELECT root, dir, markdown FROM documents_ WHERE dir = 'brand_7/small'""",
    "content_hash": f"""WITH {DOCS}
    SELECT path, strlen(content) AS size_bytes, sha256(content) AS content_hash FROM docs""",
    "decode_text": """WITH decoded AS (SELECT doc_id, CASE WHEN doc_id % 4 = 3
        THEN regexp_replace(text, '[^\\x{00}-\\x{ff}]', '?', 'g') ELSE text END AS text
        FROM documents)
    SELECT doc_id, CAST(length(text) AS INTEGER) AS characters, sha256(text) AS text_hash FROM decoded""",
    "path_parts": f"WITH {ALL} SELECT root, path, {PATH_PARTS} FROM corpus",
    "json_roundtrip": f"""WITH {RECORDS} SELECT path, CAST(json_object(
        'path', 'code/' || path, 'relative_path', name, 'size_bytes', size_bytes,
        'content_hash', content_hash, 'source', NULL, 'module_docstring', module_docstring,
        'functions', functions, 'classes', classes, 'imports', imports) AS VARCHAR) AS json,
    name, size_bytes, module_docstring, array_to_string(imports, ',') AS imports FROM records""",
    "extract_docstring": f"WITH {RECORDS} SELECT path, module_docstring FROM records",
    "extract_functions": f"""WITH {RECORDS}, {SYMBOLS}
    SELECT path, symbol, ordinal FROM symbols WHERE kind = 'function'""",
    "extract_classes": f"""WITH {RECORDS}, {SYMBOLS}
    SELECT path, symbol, ordinal FROM symbols WHERE kind = 'class'""",
    "extract_imports": f"""WITH {RECORDS}, {SYMBOLS}
    SELECT path, symbol, ordinal FROM symbols WHERE kind = 'import'""",
    "parse_failures": f"""WITH {RECORDS} SELECT root, parse_error, count(*) AS files
    FROM records WHERE parse_error IS NOT NULL GROUP BY root, parse_error""",
    "file_records": f"""WITH {RECORDS} SELECT root, path, name, size_bytes, content_hash,
    module_docstring, array_to_string(functions, ',') AS functions,
    array_to_string(classes, ',') AS classes, array_to_string(imports, ',') AS imports,
    parse_error FROM records""",
    "import_rows": f"""WITH {RECORDS} SELECT root, dir, path,
    CAST(i - 1 AS INTEGER) AS ordinal, imports[i] AS module
    FROM (SELECT *, unnest(range(1, len(imports) + 1)) AS i FROM records)""",
    "import_edges": f"""WITH {RECORDS}, {SYMBOLS}
    SELECT DISTINCT root, dir, symbol AS module FROM symbols WHERE kind = 'import'""",
    "dir_rollup": f"""WITH {CODE_DIRS} SELECT root, dir, file_count, total_size_bytes, content_hash,
    coalesce((SELECT string_agg(name, ',' ORDER BY name) FROM records r WHERE r.dir = d.dir), '')
        AS members,
    array_to_string(subdirectories, ',') AS subdirectories FROM dirs d""",
    "tree_rollup": f"""WITH {ALL}, {_hashed('corpus')}, {DIRS}
    SELECT * FROM dirs
    UNION ALL SELECT DISTINCT root, '', 0, 0, {EMPTY_HASH} FROM corpus c
    WHERE NOT EXISTS (SELECT 1 FROM dirs d WHERE d.root = c.root AND d.dir = '')""",
    "ordered_union": f"WITH {RECORDS}, {SYMBOLS}, {UNIONS} SELECT * FROM unions",
    "dir_hash": f"WITH {DOCS}, {_hashed('docs')}, {DIRS} SELECT root, dir, content_hash FROM dirs",
    "dir_hash_large": f"""WITH {DOCS}, {_hashed('docs')}, {DIRS}
    SELECT root, dir, content_hash FROM dirs""",
    "manifest_import": """SELECT 'docs' AS root, concat(source, '/', doc_id) AS dir,
    sha256(text) AS content_hash, 'imported' AS summary_status FROM documents WHERE doc_id % 3 = 0""",
    "subdirectories": f"""WITH {ALL},
    every AS (SELECT DISTINCT root, {PATH_PARTS} FROM corpus),
    nested AS (SELECT root, string_split(dir, '/') AS parts FROM every WHERE dir <> ''),
    children AS (SELECT DISTINCT root, array_to_string(list_slice(parts, 1, n - 1), '/') AS dir,
        parts[n] AS name FROM (SELECT root, parts, unnest(range(1, len(parts) + 1)) AS n FROM nested))
    SELECT root, dir, name FROM children
    WHERE NOT (name LIKE 'blog.%' OR name = 'fr' OR regexp_full_match(name, 'src1.'))""",
    "subdirectory_documents": f"""WITH {ALL}, {_hashed('corpus')}, {DIRS}, {MANIFEST},
    every AS (SELECT DISTINCT root, {PATH_PARTS} FROM corpus),
    nested AS (SELECT root, string_split(dir, '/') AS parts FROM every WHERE dir <> ''),
    children AS (SELECT DISTINCT root, array_to_string(list_slice(parts, 1, n - 1), '/') AS dir,
        parts[n] AS name FROM (SELECT root, parts, unnest(range(1, len(parts) + 1)) AS n FROM nested))
    SELECT root, dir, name, EXISTS (SELECT 1 FROM stored s WHERE s.root = children.root
        AND s.dir = concat_ws('/', nullif(children.dir, ''), children.name)) AS has_document FROM children
    WHERE NOT (name LIKE 'blog.%' OR name = 'fr' OR regexp_full_match(name, 'src1.'))""",
    "run_summary": f"""WITH status AS ({_changed(_DIFFERS)}),
    {ALL}, {_hashed('corpus')}, {DIRS}
    SELECT count(*) FILTER (changed) AS written, count(*) FILTER (NOT changed) AS skipped,
        count(*) FILTER (changed AND total_size_bytes % 3 = 0) AS errors
    FROM status JOIN dirs USING (root, dir)""",
    "changed_dirs": _changed(_DIFFERS),
    "changed_dirs_force": _changed("true"),
    "changed_dirs_retry": _changed(f"({_DIFFERS} OR stored_status = 'failed')"),
    "attach_summary": f"""WITH {CODE_DIRS} SELECT root, dir,
    CASE WHEN file_count % 2 = 0 THEN overview ELSE '' END AS overview,
    CASE WHEN file_count % 2 = 0 THEN array_to_string(key_symbols, ',') ELSE '' END AS key_symbols,
    CASE WHEN file_count % 2 = 0 THEN 'ok' ELSE 'none' END AS summary_status,
    file_count = 0 AS is_empty, file_count % 2 = 0 AS has_content FROM summarized""",
    "sorted_listing": f"""WITH {ALL} SELECT root, path,
    row_number() OVER (ORDER BY root, string_split(path, '/')) AS position FROM corpus""",
    "preview_truncated": f"""WITH {WITH_SUMMARY} SELECT root, dir, CASE WHEN length(markdown) > 800
    THEN concat(left(markdown, 800), chr(10), '…[truncated]') ELSE markdown END AS markdown
    FROM documents_""",
    "prompt_text": f"WITH {PROMPTS} SELECT root, dir, prompt FROM prompts",
    "prompt_messages": f"""WITH {PROMPTS} SELECT root, dir, 0 AS position, 'system' AS role,
        {_lines(SYSTEM_MESSAGE)} AS content FROM prompts
    UNION ALL SELECT root, dir, 1, 'user', prompt FROM prompts""",
    "summary_parse": f"""WITH raw AS (SELECT event_id, trim({ANSWER}, concat(' ', chr(10))) AS raw
        FROM events),
    cleaned AS (SELECT event_id, CASE WHEN starts_with(raw, '```') THEN regexp_replace(
        regexp_replace(raw, '^[^\\n]*\\n', ''), '\\s*```$', '') ELSE raw END AS answer FROM raw),
    typed AS (SELECT event_id, answer, json_valid(answer) AS valid,
        CASE WHEN json_valid(answer) THEN json_type(answer) END AS type FROM cleaned),
    fields AS (SELECT event_id, valid, type,
        CASE WHEN type = 'OBJECT' THEN CAST(answer AS JSON) ELSE CAST('{{}}' AS JSON) END AS j
        FROM typed)
    SELECT event_id,
        CASE WHEN NOT valid THEN 'bad_json' WHEN type <> 'OBJECT' THEN 'not_object'
            WHEN coalesce(json_type(j, '$.key_symbols'), 'ARRAY') <> 'ARRAY'
                OR coalesce(json_type(j, '$.patterns'), 'ARRAY') <> 'ARRAY'
                OR coalesce(json_type(j, '$.tribal_knowledge'), 'ARRAY') <> 'ARRAY'
            THEN 'bad_field' ELSE 'ok' END AS parse_status,
        coalesce(j->>'$.overview', '') AS overview,
        coalesce(array_to_string(j->>'$.key_symbols[*]', ','), '') AS key_symbols,
        coalesce(array_to_string(j->>'$.patterns[*]', ','), '') AS patterns,
        coalesce(array_to_string(j->>'$.tribal_knowledge[*]', ','), '') AS tribal_knowledge
    FROM fields""",
    "extractive_summary": f"""WITH {CODE_DIRS} SELECT root, dir, '[auto] ' || overview AS overview,
    array_to_string(key_symbols, ',') AS key_symbols FROM summarized""",
    "render_vars": f"""WITH {CODE_DIRS} SELECT path, dir_name, content_hash, file_count, overview,
    true AS has_summary, '2024-01-01T00:00:00Z' AS generated_at,
    concat('<!-- content-hash: ', content_hash, ' -->') AS hash_line,
    array_to_string(subdirectories, ',') AS subdirectories,
    array_to_string(all_functions, ',') AS all_functions,
    array_to_string(all_classes, ',') AS all_classes,
    array_to_string(all_imports, ',') AS all_imports,
    array_to_string(key_symbols, ',') AS key_symbols, '' AS patterns, '' AS tribal_knowledge
    FROM summarized""",
    "render_document": f"WITH {WITH_SUMMARY} SELECT root, dir, content_hash, markdown FROM documents_",
    "render_large": f"""WITH {WITH_SUMMARY} SELECT root, dir, sha256(markdown) AS text_hash,
    length(markdown) AS characters FROM documents_""",
    "render_no_summary": f"WITH {NO_SUMMARY} SELECT root, dir, content_hash, markdown FROM documents_",
    "render_custom": f"""WITH {CODE_DIRS} SELECT root, dir, concat('= ', dir_name, ' =', chr(10),
    (SELECT string_agg(concat('* ', name, chr(10)), '' ORDER BY name) FROM records r
        WHERE r.dir = d.dir), '<!-- content-hash: ', content_hash, ' -->') AS markdown FROM dirs d""",
    "summarize_udf": f"""WITH {PROMPTS} SELECT root, dir, concat(path, ' ', length(prompt)) AS overview,
    concat(path, ',1') AS key_symbols, 'ok' AS summary_status, 1 AS attempts, CAST(NULL AS VARCHAR) AS error
    FROM prompts""",
    "summarize_retry": f"""WITH {PROMPTS} SELECT root, dir,
    concat(path, ' ', length(prompt)) AS overview, concat(path, ',1') AS key_symbols,
    'ok' AS summary_status, 2 AS attempts, CAST(NULL AS VARCHAR) AS error FROM prompts""",
    "summarize_errors": f"""WITH {PROMPTS}, judged AS (
        SELECT *, length(prompt) % 3 = 0 AS refused FROM prompts)
    SELECT root, dir, CASE WHEN refused THEN '' ELSE concat(path, ' ', length(prompt)) END AS overview,
    CASE WHEN refused THEN '' ELSE concat(path, ',1') END AS key_symbols,
    CASE WHEN refused THEN 'failed' ELSE 'ok' END AS summary_status,
    CASE WHEN refused THEN 3 ELSE 1 END AS attempts,
    CASE WHEN refused THEN 'ValueError: refused' END AS error FROM judged""",
    "incremental_write": f"""WITH {CODE_DIRS},
    touched AS (SELECT count(DISTINCT dir) AS n FROM records WHERE path LIKE '%97.py'),
    every AS (SELECT count(*) AS n FROM dirs)
    SELECT 1 AS run, n AS written, 0 AS skipped, CAST(0 AS BIGINT) AS errors FROM every
    UNION ALL SELECT 2, 0, n, 0 FROM every
    UNION ALL SELECT 3, t.n, e.n - t.n, 0 FROM every e, touched t""",
    "export_documents": f"""WITH {WITH_SUMMARY}
    SELECT root, dir, strlen(markdown) AS bytes, CAST(NULL AS VARCHAR) AS error FROM documents_""",
    "purge_listing": f"""WITH {ALL}, {_hashed('corpus')}, {DIRS}, {MANIFEST}
    SELECT root, dir FROM stored
    WHERE root = 'web' OR (root = 'docs' AND (dir = 'src3' OR dir LIKE 'src3/%'))""",
    "purge_effect": f"""WITH {CODE_DIRS},
    judged AS (SELECT root, dir, dir = 'brand_1' OR dir LIKE 'brand_1/%' AS gone FROM dirs)
    SELECT root, dir, true AS stored, true AS exported,
        (SELECT count(*) FILTER (gone) FROM judged) AS deleted, CAST(0 AS BIGINT) AS failed
    FROM judged WHERE NOT gone""",
}
