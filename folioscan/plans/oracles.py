"""DuckDB SQL for the registered queries of the search engine: written on its own, to check them against."""

from __future__ import annotations

from . import catalogue as C

# Fixed values, written here once more, so that one that is missing in the library shows.
STOP_WORDS = """le la les un une des du de et ou en au aux ce ces cet cette mon ma mes ton ta tes son sa ses notre nos votre vos leur leurs
    je tu il elle on nous vous ils elles qui que quoi dont où ne pas plus sur sous dans par pour avec sans chez est sont été être avoir ai as
    avons ont se ça cela ceci mais donc car ni si the of and to in is for with""".split()
QUERY_STOP_WORDS = "fichier fichiers dossier dossiers document documents cherche chercher trouve trouver retrouve retrouver moi veux besoin".split()
_FROM, _TO = "àâäáãéèêëîïíôöóõùûüúçñÿ", "aaaaaeeeeiiioooouuuucny"
SECRET_NAMES = "id_rsa id_ed25519 id_ecdsa .htpasswd credentials credentials.csv accesskeys.csv rootkey.csv passwords.csv logins.csv".split()
SECRET_ENDINGS = [*".pem .key .p12 .pfx .kdbx .keychain .keychain-db .gpg _credentials.csv _accesskeys.csv".split(), " passwords.csv"]
SECRET_BEGINNINGS, SECRET_PARTS = (".env", "bitwarden_export"), ("recovery-codes", "backup-codes")
EXCLUDED_FOLDERS = ("node_modules", "__pycache__", "venv", "site-packages", "$recycle.bin", "system volume information")
BUNDLE_ENDINGS, HOME_FOLDERS = (".app", ".framework", ".photoslibrary"), ("library", "appdata")
READABLE = "txt md markdown csv tsv log rst html htm pdf docx pptx xlsx odt ods odp".split()
#: Words of the registered searches that are looked for, and their stems.
TERMS = {
    C.BOTH: (("edinst", "edinst"), ("onst", "onst")),
    C.ANY: (("edinst", "edinst"), ("lyer", "lyer"), ("quees", "quee")),
    C.NOWHERE: (("onst", "onst"), ("zzzqqq", "zzzqqq")),
    C.PART_QUERY: (("blue", "blue"), ("src1", "src1"), ("edinst", "edinst")),
}


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


WORD = r"[\p{L}\p{N}]+"
_WORDS = rf"select lower(w) as word from (select unnest(regexp_extract_all(text, '{WORD}')) as w from documents)"
_COUNTS = f"select word, count(*) as n from ({_WORDS}) group by word"
_KEPT = f"length(word) between 2 and 40 and word not in ({_quoted(STOP_WORDS)})"
_LIGHT = "case when length(word) > 3 then regexp_replace(word, '[sx]$', '') else word end"
_DOC_NAME = "source || '_' || doc_id || '.txt'"
_DOC_FILES = f"""select doc_id as id, '/' || source || '/' || {_DOC_NAME} as path, {_DOC_NAME} as name, 'txt' as ext, n_chars as size,
    {C.MTIME} + doc_id as mtime, 'ok' as status, '/' || source as root from documents"""
_PART_FILES = f"""select 1000000000 + p_partkey as id, '/parts/' || p_partkey || '/' || p_name || '.png' as path, p_name || '.png' as name, 'png' as ext,
    16::bigint as size, {C.MTIME}::bigint as mtime, 'name_only' as status, '/parts' as root from part"""
_ALL_FILES = f"{_DOC_FILES} union all {_PART_FILES}"
_NAME_WORDS = rf"regexp_extract_all(regexp_replace(name, '^(.+)\.[^.]*$', '\1'), '{WORD}')"


def _index(files: str) -> str:
    """Common table expressions files, postings and lengths."""
    return rf"""files as ({files}),
        named as (select id, lower(w) as word from (select id, unnest({_NAME_WORDS}) as w from files)),
        body as (select doc_id as id, lower(w) as word from (select doc_id, unnest(regexp_extract_all(text, '{WORD}')) as w from documents)),
        tokens as (select id, 'name' as col, strip_accents(word) as token from named
                   union all select id, 'stems', strip_accents({_LIGHT}) from (select * from named union all select * from body) where {_KEPT}),
        postings as (select id as file_id, col, token, count(*)::bigint as tf from tokens group by all),
        lengths as (select f.id as file_id, coalesce(sum(tf) filter (col = 'name'), 0)::bigint as n_name, coalesce(sum(tf) filter (col = 'stems'), 0)::bigint as n_stems
                    from files f left join postings p on p.file_id = f.id group by f.id)"""


def _kept_index(columns: str) -> str:
    """Files of the index after some documents came, some changed and some vanished."""
    now = "select * replace (case when doc_id % 10 = 1 then text || ' zzzqqq' else text end as text, case when doc_id % 10 = 1 then length(text) + 7 else length(text) end as n_chars) from main.documents where doc_id % 10 <> 7"
    return f"with documents as ({now}), {_index(_DOC_FILES)} select {columns} from files join lengths on file_id = id"


def _phrases(text: str) -> str:
    rows = [f"({2 * i + k}, {i}, '{c}', {w}, strip_accents('{x}'))" for i, (t, s) in enumerate(TERMS[text]) for k, (c, w, x) in enumerate((("name", "8.0::double", t), ("stems", "1.0::double", s)))]
    return f"phrases(phrase, term, col, weight, prefix) as (values {', '.join(rows)})"


def _found(files: str, text: str) -> str:
    return rf"""with {_index(files)}, {_phrases(text)},
        counts as (select p.file_id, q.phrase, q.term, q.weight, sum(p.tf)::double as tf
                   from postings p join phrases q on p.col = q.col and starts_with(p.token, q.prefix) group by all),
        totals as (select count(*)::double as n, avg(n_name + n_stems)::double as mean from lengths),
        idf as (select phrase, case when ln((n - df + 0.5::double) / (df + 0.5::double)) > 0 then ln((n - df + 0.5::double) / (df + 0.5::double)) else 1e-6::double end as idf
                from (select phrase, count(*)::double as df from counts group by phrase), totals),
        found as (select c.file_id, count(distinct term) as n_terms,
                         sum(idf * weight * tf * 2.2::double / (weight * tf + 1.2::double * (0.25::double + 0.75::double * (n_name + n_stems) / mean))) as score
                  from counts c join idf using (phrase) join lengths using (file_id), totals group by c.file_id)"""


def _search(files: str, text: str, mode: str, limit: int = 30) -> str:
    n = len(TERMS[text])
    keep = {"and": f"n_terms = {n}", "or": "true", "fallback": f"n_terms = {n} or not exists (select * from found where n_terms = {n})"}[mode]
    every = {"and": "true", "or": "false", "fallback": f"exists (select * from found where n_terms = {n})"}[mode]
    return rf"""{_found(files, text)},
        top as (select file_id as id, n_terms, score, row_number() over (order by status = 'ok' desc, round(score, 9) desc, file_id) as rank
                from found join files on files.id = found.file_id where {keep})
        select rank::int as rank, id, n_terms, round(score, 6) as score, {every} as every_word from top where rank <= {limit}"""


#: Words of the users' turns as queries: without stop words and fillers, or if none is left all of two characters up.
_ASKED = rf"""said as (select conv_id || '/' || turn as query_id, list_transform(regexp_extract_all(text, '{WORD}'), lambda w: lower(w)) as ws from conversations where role = 'user'),
    kept as (select query_id, ws, list_filter(ws, lambda w: length(w) >= 2 and w not in ({_quoted(STOP_WORDS)}) and w not in ({_quoted(QUERY_STOP_WORDS)})) as ks from said),
    terms as (select query_id, unnest(list_distinct(case when len(ks) > 0 then ks else list_filter(ws, lambda w: length(w) >= 2) end)) as word from kept),
    phrases as (select query_id, word as term, 'name' as col, 8.0::double as weight, strip_accents(word) as prefix from terms
                union all select query_id, word, 'stems', 1.0::double, strip_accents({_LIGHT}) from terms)"""


def _search_many(files: str, limit: int = 10) -> str:
    return rf"""with {_index(files)}, {_ASKED},
        pairs as (select q.col, q.prefix, t.token from (select distinct col, prefix from phrases) q join (select distinct col, token from postings) t
                  on q.col = t.col and left(q.prefix, 1) = left(t.token, 1) and starts_with(t.token, q.prefix)),
        held as materialized (select x.col, x.prefix, p.file_id, sum(p.tf)::double as tf from pairs x join postings p using (col, token) group by all),
        totals as (select count(*)::double as n, avg(n_name + n_stems)::double as mean from lengths),
        idf as (select col, prefix, greatest(ln((n - df + 0.5::double) / (df + 0.5::double)), 0) as raw from (select col, prefix, count(*)::double as df from held group by all), totals),
        found as (select q.query_id, h.file_id, count(distinct q.term) as n_terms,
                         sum(case when raw > 0 then raw else 1e-6::double end * weight * tf * 2.2::double / (weight * tf + 1.2::double * (0.25::double + 0.75::double * (n_name + n_stems) / mean))) as score
                  from phrases q join held h using (col, prefix) join idf using (col, prefix) join lengths using (file_id), totals group by all),
        best as (select f.*, max(n_terms) over (partition by query_id) = w.n as every_word, w.n as wanted
                 from found f join (select query_id, count(distinct word) as n from terms group by 1) w using (query_id)),
        top as (select query_id, file_id as id, n_terms, score, every_word,
                       row_number() over (partition by query_id order by status = 'ok' desc, round(score, 9) desc, id) as rank
                from best join files on files.id = best.file_id where not every_word or n_terms = wanted)
        select query_id, rank::int as rank, id, n_terms, round(score, 6) as score, every_word from top where rank <= {limit}"""


def _passages(rows: str) -> str:
    """(file_id, snippet) of rows (file_id, text): bytes from 90 before the first matched word to 220 after it."""
    low = "lower(t)"
    stem = f"translate(case when length({low}) > 3 then regexp_replace({low}, '[sx]$', '') else {low} end, '{_FROM}', '{_TO}')"
    matched = " or ".join(f"starts_with({stem}, '{s}')" for _, s in TERMS[C.ANY])
    pieces = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"
    return rf"""rows as ({rows}), cut as (select file_id, regexp_extract_all(text, '{pieces}') as ts from rows),
        met as (select *, list_position(list_transform(ts, lambda t: {matched}), true) as i from cut),
        sides as (select file_id, ts[i] as word, array_to_string(ts[1:i - 1], '') as b, array_to_string(ts[i + 1:], '') as a from met where i > 0),
        shown as (select *, coalesce(list_filter(range(1, 91), lambda k: strlen(right(b, k)) >= 90)[1], length(b)) as nb,
                  coalesce(list_filter(range(1, 221), lambda k: strlen(left(a, k)) >= 220)[1], length(a)) as na from sides),
        flat as (select *, trim(regexp_replace(right(b, nb) || word || left(a, na), '\s+', ' ', 'g')) as text from shown),
        passages as (select file_id, case when nb < length(b) then '…' else '' end
                     || array_to_string(list_transform(regexp_extract_all(text, '{pieces}'), lambda t: case when {matched} then chr(1) || t || chr(2) else t end), '')
                     || case when na < length(a) then '…' else '' end as snippet from flat)"""


_MADE = f"""select p_partkey as id,
    case when p_partkey % 3 = 0 then ending else p_name || ending end as name, p_partkey % 2 = 0 as is_folder,
    case when p_partkey % 4 = 0 then '/home/me' else '/data' end as parent, p_size::bigint * 4000000 as size,
    case when p_partkey % 5 = 0 then null when p_partkey % 5 = 1 then ' ' || chr(10) else p_name end as text
    from (select *, [{_quoted(C.NAME_ENDINGS)}][(p_partkey % {len(C.NAME_ENDINGS)} + 1)::int] as ending from part)"""


def _ends(column: str, endings) -> str:
    return "(" + " or ".join(f"ends_with({column}, '{e}')" for e in endings) + ")"


_SECRET = (
    f"(n in ({_quoted(SECRET_NAMES)}) or {_ends('n', SECRET_ENDINGS)}"
    + "".join(f" or starts_with(n, '{b}')" for b in SECRET_BEGINNINGS)
    + "".join(f" or contains(n, '{p}')" for p in SECRET_PARTS)
    + ")"
)
_EXT = r"lower(regexp_extract(name, '^.+\.([^.]*)$', 1))"
_SNAPSHOTS = f"""files as ({_DOC_FILES}), known as (select * from files where id % 10 <> 3),
    now as (select id, path, case when id % 10 = 1 then size + 1 else size end as size, case when id % 10 = 2 then mtime + 5 else mtime end as mtime from files where id % 10 <> 7),
    actions as (select coalesce(n.path, k.path) as path, k.id as id,
                case when k.path is null then 'new' when n.path is null then 'removed' when n.size = k.size and n.mtime = k.mtime then 'unchanged' else 'changed' end as action
                from now n full join known k on n.path = k.path)"""
#: Pieces of HTML: scripts and styles, tags, an open tag up to the end, text.
_PIECES = r"(?is)<\s*script/*(?:\s[^>]*)?>.*?(?:</script[^>]*(?:>|\z)|\z)|<\s*style/*(?:\s[^>]*)?>.*?(?:</style[^>]*(?:>|\z)|\z)|<[^>]*>|<.*|[^<]+"


def _named(text: str) -> str:
    for entity, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "''"), ("nbsp", " "), ("amp", "&")):
        text = f"replace({text}, '&{entity};', '{char}')"
    return text


def _html() -> str:
    block = r"(?is)<\s*(?:p|/p|div|/div|br|li|/li|tr|/tr|h[1-6]|/h[1-6])/*(?:\s[^>]*)?>"
    piece = f"case when left(t, 1) <> '<' then t when regexp_full_match(t, '{block}') then chr(10) else '' end"
    plain = f"array_to_string(list_transform(regexp_extract_all(html, '{_PIECES}'), lambda t: {piece}), '')"
    return f"select page_id, {_named('plain')} as text from (select page_id, {plain} as plain from pages)"


ORACLES: dict[str, str] = {
    "word_counts": _COUNTS,
    "stop_filtered_terms": f"select * from ({_COUNTS}) where {_KEPT}",
    "plural_stripped_terms": f"select {_LIGHT} as stem, sum(n)::bigint as n, count(*) as words from ({_COUNTS}) group by 1",
    "accent_folded_terms": f"select translate(word, '{_FROM}', '{_TO}') as folded, strip_accents(word) as token, sum(n)::bigint as n from ({_COUNTS}) group by 1, 2",
    "name_words": f"select id, lower(array_to_string({_NAME_WORDS}, ' ')) as name_words from ({_ALL_FILES})",
    "html_text": _html(),
    "html_entities": f"select entity, count(*) as n, {_named('entity')} as decoded from (select unnest(regexp_extract_all(html, '&[a-z]+;')) as entity from pages) group by 1",
    "xml_text": "select doc_id, replace(text, chr(10), chr(10) || ' ') || chr(10) as text from documents",
    "sensitive_names": f"select id, name, {_SECRET} as sensitive from (select *, lower(name) as n from ({_MADE}))",
    "excluded_paths": f"""select id, name, starts_with(name, '.') or (is_folder and (n in ({_quoted(EXCLUDED_FOLDERS)}) or {_ends('n', BUNDLE_ENDINGS)}
        or (n in ({_quoted(HOME_FOLDERS)}) and parent = '/home/me'))) as excluded from (select *, lower(name) as n from ({_MADE}))""",
    "extension_status": f"""select id, ext, ext in ({_quoted(READABLE)}) as readable,
        case when ext not in ({_quoted(READABLE)}) then 'name_only' when size > {150 * 1024 * 1024} then 'too_large' when text is null then 'unreadable'
             when trim(text, ' ' || chr(10)) = '' then 'empty' else 'ok' end as status from (select *, {_EXT} as ext from ({_MADE}))""",
    "roots": f"select root, count(*) as files from ({_ALL_FILES}) group by root order by root",
    "total_files": f"select count(*) as files from ({_ALL_FILES})",
    "index_stats": f"""select count(*) as files, count(*) filter (status = 'ok') as with_text, count(*) filter (status = 'name_only') as name_only,
        count(*) filter (status in ('unreadable', 'empty', 'too_large')) as unreadable,
        (select coalesce(sum(length(text)), 0)::bigint from documents) as text_bytes from ({_ALL_FILES})""",
    "known_files": f"select id, path, size, mtime from ({_ALL_FILES}) where root = '/src1'",
    "sync_plan": f"with {_SNAPSHOTS} select path, action, id from actions",
    "sync_report": f"""with {_SNAPSHOTS} select count(*) filter (action <> 'removed') as seen, count(*) filter (action in ('new', 'changed')) as indexed,
        count(*) filter (action = 'unchanged') as unchanged, count(*) filter (action = 'removed') as removed from actions""",
    "incremental_index": _kept_index("path, size, mtime, status, n_name + n_stems as tokens"),
    "streamed_index": _kept_index("path, mtime, status, n_name + n_stems as tokens"),
    "forget_root": f"""with f as ({_ALL_FILES}) select 'files' as part, count(*) as n from f where root <> '/src1'
        union all select 'texts', count(*) from documents where source <> 'src1' union all select 'removed', count(*) from f where root = '/src1'""",
    "root_adoption": f"select case when root in ('/src1', '/src2') then '/' else root end as root, count(*) as files from ({_DOC_FILES}) group by 1",
    "root_overlap": """select root, asked, starts_with(asked, root || '/') as rejected, starts_with(root, case when asked = '/' then '' else asked end || '/') as adopted
        from (select distinct '/' || source as root from documents), (values ('/src1'), ('/src1/deeper'), ('/src10'), ('/'), ('/other')) a(asked)""",
    "status_migration": "select doc_id, ['too_large', 'empty', 'unreadable', 'name_only', 'ok'][(doc_id % 5 + 1)::int] as status from documents",
    "posting_list": f"with {_index(_DOC_FILES)} select * from postings",
    "doc_lengths": f"with {_index(_ALL_FILES)} select * from lengths",
    "doc_freq": f"with {_index(_DOC_FILES)}, {_phrases(C.ANY)} select phrase, count(distinct file_id) as df from postings p join phrases q on p.col = q.col and starts_with(p.token, q.prefix) group by phrase",
    "search_and": _search(_DOC_FILES, C.BOTH, "and"),
    "search_or": _search(_DOC_FILES, C.ANY, "or"),
    "search_fallback": _search(_DOC_FILES, C.NOWHERE, "fallback"),
    "search_text_before_name_only": _search(_ALL_FILES, C.PART_QUERY, "or"),
    "search_hits": f"select t.rank, f.path, f.name, f.ext, f.size, f.mtime, t.score from ({_search(_DOC_FILES, C.ANY, 'or', 10)}) t join ({_DOC_FILES}) f using (id)",
    "search_top_and": _search(_DOC_FILES, C.BOTH, "and"),
    "search_top_or": _search(_DOC_FILES, C.ANY, "or"),
    "search_top_fallback": _search(_DOC_FILES, C.NOWHERE, "fallback"),
    "search_top_text_first": _search(_ALL_FILES, C.PART_QUERY, "or"),
    "search_many": _search_many(_ALL_FILES),
    "search_passages": f"""with top as ({_search(_DOC_FILES, C.ANY, 'or', 10)}), {_passages("select d.doc_id as file_id, d.text from documents d join top on top.id = d.doc_id")}
        select t.rank, f.path, p.snippet, replace(replace(p.snippet, chr(1), chr(27) || '[1m'), chr(2), chr(27) || '[0m') as bold,
               len(regexp_extract_all(p.snippet, chr(1) || '[^' || chr(2) || ']*' || chr(2) || '|[^' || chr(1) || ']+'))::int as n_parts
        from top t join ({_DOC_FILES}) f using (id) left join passages p on p.file_id = t.id""",
    "all_passages": f"with {_passages('select doc_id as file_id, text from documents')} select d.doc_id as file_id, snippet from documents d left join passages on file_id = d.doc_id",
    "stem_vocabulary": f"""with {_index(_DOC_FILES)}, every as (select f.root, word from (select * from named union all select * from body) t join files f on f.id = t.id where {_KEPT}),
        w as (select word, min(case when root = '/src1' then 1 else 2 end)::int as step from every group by word) select word, {_LIGHT} as stem, step from w""",
    "owning_roots": f"""with f as ({_DOC_FILES}), paths as (select root || '/' || id % 4 || '/' || id % 3 || '/' || name as path from f),
        known as (select distinct * from (select root from f union all select root || '/' || id % 4 from f where id % 4 < 2 union all select root || '/1/1' from f where id % 12 = 1) where root not like '/src2%')
        select path, arg_max(root, length(root)) as root, count(root) as roots from paths left join known on path = root or starts_with(path, root || '/') group by path""",
    "hit_lookup": f"select t.rank, t.id, f.path, f.size, md5(d.text) as body_md5 from ({_search(_ALL_FILES, C.ANY, 'or')}) t join ({_ALL_FILES}) f using (id) join documents d on d.doc_id = t.id",
    "hit_display": f"""select id, case when s < 1024 then s || ' B' when s < 1048576 then floor(s / 1024 + 0.5)::bigint || ' KB' else printf('%.1f', floor(s::double / 1048576 * 10 + 0.5) / 10) || ' MB' end as size,
        size // 1024 as kb, case when id % 7 = 0 then '' else strftime(make_timestamp(mtime * 1000000), '%-d %b %Y') end as date,
        name as short_name, substr(root, 2) || ' › a › b' as location, greatest(size - 500, 0) as read_in_full
        from (select *, size * 997 as s from ({_DOC_FILES}))""",
}
