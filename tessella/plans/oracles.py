"""SQL for DuckDB that gives the rows of the catalogue's queries by plain means."""

from __future__ import annotations

from tessella.operators.similarity import PRIME, SimilarityConfig, coefficients
from tessella.plans.catalogue import FILES

_GROUPS = """g AS (SELECT sha256(text) AS hash, size, count(*) AS n_files, arg_min(path, string_split(path, '/')) AS first_path FROM f GROUP BY text, size HAVING count(*) > 1)"""
_REPS = """r AS (SELECT * FROM f WHERE path NOT IN (SELECT f.path FROM f JOIN g ON sha256(f.text) = g.hash WHERE f.path <> g.first_path))"""
_CACHE = """c AS (SELECT path, size, mtime_ms + doc_id % 5 * 1000 AS mtime_ms, CASE WHEN doc_id % 2 = 0 THEN md5(text) END AS sample_hash, sha256(text) AS full_hash FROM f WHERE doc_id % 3 <> 0)"""
_TOKENS = r"""w AS (SELECT path, doc_id, list_transform(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}]+'), lambda x: x <> ''), lambda x: lower(x)) AS ws FROM SRC),
k AS (SELECT DISTINCT path, doc_id, ('0x' || substr(md5(s), 1, 15))::BIGINT AS t FROM (SELECT path, doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w))"""
_TREES = """src AS (SELECT path AS relative_path, size, sha256(text) AS hash, lower(replace(path, '\\', '/')) AS key FROM f),
dst AS (SELECT relative_path, strlen(text)::BIGINT AS size, sha256(text) AS hash, lower(replace(relative_path, '\\', '/')) AS key FROM (
  SELECT CASE WHEN doc_id % 7 = 1 THEN 'moved/' || path WHEN doc_id % 11 = 4 THEN upper(path) ELSE path END AS relative_path,
    CASE WHEN doc_id % 7 = 2 THEN substring(text, 1, 3) WHEN doc_id % 7 = 3 THEN '#' || substring(text, 2) ELSE text END AS text FROM f WHERE doc_id % 5 <> 0
  UNION ALL SELECT 'extra/' || path, 'only here ' || path FROM f WHERE doc_id % 13 = 0))""".replace("\\\\", "\\")
_PLAN = """met AS (SELECT s.*, d.relative_path AS d_path, d.size AS d_size, d.hash AS d_hash FROM src s LEFT JOIN dst d ON s.key = d.key),
residue AS (SELECT * FROM dst WHERE key NOT IN (SELECT key FROM src)),
target AS (SELECT hash, arg_min(relative_path, string_split(relative_path, '/')) AS t FROM residue GROUP BY hash),
states AS (SELECT m.relative_path, m.size, CASE WHEN d_size IS NOT NULL AND d_size <> m.size THEN 'partial' WHEN d_hash = m.hash THEN 'verified'
    WHEN d_size IS NOT NULL THEN 'conflict' WHEN t IS NOT NULL THEN 'moved' ELSE 'missing' END AS state, coalesce(d_path, t) AS destination_relative, '' AS issues
  FROM met m LEFT JOIN target ON m.d_size IS NULL AND target.hash = m.hash),
plan AS (SELECT * FROM states UNION ALL SELECT relative_path, size, 'destination_only', relative_path, '' FROM residue
  WHERE relative_path NOT IN (SELECT destination_relative FROM states WHERE state = 'moved'))"""


def _similar() -> str:
    """Common table expressions up to ``pairs``, with every hash function spelled out."""
    c = SimilarityConfig()
    sigs = ", ".join(f"min(({a}::HUGEINT * t + {b}) % {PRIME})::BIGINT" for a, b in coefficients(c.seed, c.num_hashes))
    r = c.rows_per_band
    return f"""{FILES}, {_GROUPS}, {_REPS}, {_TOKENS.replace("SRC", "r")},
sig AS (SELECT path, [{sigs}] AS s, list(t) AS ts FROM k GROUP BY path),
band AS (SELECT path, b, s[b * {r} + 1:b * {r} + {r}] AS bucket FROM sig, range(0, {c.bands}) x(b)),
hub AS (SELECT b, bucket, min(path) AS hub FROM band GROUP BY ALL HAVING count(*) > 1),
edge AS (SELECT DISTINCT path AS x, hub AS y FROM band JOIN hub ON band.b = hub.b AND band.bucket = hub.bucket WHERE path <> hub),
both_ways AS (SELECT x, y FROM edge UNION SELECT y, x FROM edge),
walk AS (SELECT x AS p, x AS q FROM both_ways UNION SELECT w.p, e.y FROM walk w JOIN both_ways e ON e.x = w.q),
comp AS (SELECT p AS path, min(q) AS c FROM walk GROUP BY p),
cand AS (SELECT a.path AS a, b.path AS b, a.ts AS ta, b.ts AS tb,
    len(list_filter(range(1, {c.num_hashes + 1}), lambda i: a.s[i] = b.s[i])) / {c.num_hashes} AS jaccard
  FROM comp x JOIN comp y ON x.c = y.c JOIN sig a ON a.path = x.path JOIN sig b ON b.path = y.path
  WHERE string_split(x.path, '/') < string_split(y.path, '/')),
cov AS (SELECT a, b, jaccard, len(list_intersect(ta, tb)) / len(ta) AS a_to_b, len(list_intersect(ta, tb)) / len(tb) AS b_to_a FROM cand WHERE jaccard >= {c.cutoff}),
pairs AS (SELECT *, CASE WHEN a_to_b >= 0.8 AND b_to_a >= 0.8 THEN 'near_duplicate' WHEN a_to_b >= 0.8 THEN 'b_is_more_complete'
  WHEN b_to_a >= 0.8 THEN 'a_is_more_complete' ELSE 'diverged' END AS relationship FROM cov)"""


_RANKED = """ok AS (SELECT * FROM pairs WHERE relationship <> 'diverged'),
ce AS (SELECT a AS x, b AS y FROM ok UNION SELECT b, a FROM ok),
cw AS (SELECT x AS p, x AS q FROM ce UNION SELECT w.p, e.y FROM cw w JOIN ce e ON e.x = w.q),
fam AS (SELECT p AS path, min(q) AS family FROM cw GROUP BY p),
holds AS (SELECT a AS x, b AS y FROM ok WHERE relationship IN ('near_duplicate', 'a_is_more_complete') UNION SELECT b, a FROM ok WHERE relationship IN ('near_duplicate', 'b_is_more_complete')),
reach AS (SELECT x, y FROM holds UNION SELECT r.x, h.y FROM reach r JOIN holds h ON h.x = r.y),
done AS (SELECT x AS path, count(*) AS n FROM reach GROUP BY x),
ranked AS (SELECT family, fam.path, (row_number() OVER (PARTITION BY family ORDER BY coalesce(n, 0) DESC, mtime_ms DESC, string_split(fam.path, '/')))::INTEGER AS rank,
  coalesce(n, 0) AS completeness, fam.path NOT IN (SELECT y FROM reach WHERE x <> y) AS is_tip
  FROM fam JOIN f ON f.path = fam.path LEFT JOIN done ON done.path = fam.path)"""
_DECIDED = """decided AS (SELECT f.path, f.size, CASE WHEN g.first_path = f.path THEN 'kept' WHEN g.hash IS NOT NULL THEN 'exact_duplicate' WHEN rank IS NULL THEN 'kept'
    WHEN is_tip THEN 'tip' WHEN rank <= 1 THEN 'within_keep_newest' ELSE 'older_version' END AS reason
  FROM f LEFT JOIN g ON g.hash = sha256(f.text) LEFT JOIN ranked r ON r.path = f.path),
acted AS (SELECT path, size, CASE WHEN reason IN ('exact_duplicate', 'older_version') THEN 'collapse' ELSE 'keep' END AS action, reason FROM decided)"""


def oracles() -> dict[str, str]:
    similar = _similar()
    plan = f"WITH {FILES}, {_TREES}, {_PLAN}"
    diff = f"""WITH {FILES}, {_TREES}, first AS (SELECT hash, arg_min(relative_path, string_split(relative_path, '/')) AS p FROM dst GROUP BY hash),
x AS (SELECT s.relative_path, CASE WHEN d.hash = s.hash THEN 'unchanged' WHEN d.hash IS NOT NULL THEN 'changed' WHEN p IS NOT NULL THEN 'moved' ELSE 'deleted' END AS status,
  CASE WHEN d.hash IS NOT NULL THEN s.relative_path ELSE p END AS current_path FROM src s LEFT JOIN dst d ON d.relative_path = s.relative_path LEFT JOIN first ON first.hash = s.hash)
SELECT * FROM x UNION ALL SELECT relative_path, 'unrecorded', relative_path FROM dst WHERE relative_path NOT IN (SELECT current_path FROM x WHERE current_path IS NOT NULL)"""
    return {
        "duplicate_paths": f"""WITH {FILES} SELECT sha256(text) AS sha256, size, path AS relative_path FROM f WHERE sha256(text) IN (SELECT sha256(text) FROM f GROUP BY 1 HAVING count(*) > 1)""",
        "manifest_families": f"""WITH RECURSIVE {similar}, {_RANKED}, named AS (SELECT family, row_number() OVER (ORDER BY count(*) DESC, family) - 1 AS k FROM ranked GROUP BY family)
            SELECT printf('f_%05d', k) AS family_id, rank, path FROM ranked JOIN named ON named.family = ranked.family""",
        "journal_runs": f"""{plan}, back AS (SELECT (SELECT count(*) FROM dst) + (SELECT count(*) FROM src WHERE key NOT IN (SELECT key FROM dst)
              AND relative_path NOT IN (SELECT t FROM (SELECT d.hash, arg_min(s.relative_path, string_split(s.relative_path, '/')) AS t FROM (SELECT * FROM src WHERE key NOT IN (SELECT key FROM dst)) s
                JOIN (SELECT * FROM dst WHERE key NOT IN (SELECT key FROM src)) d ON d.hash = s.hash GROUP BY d.hash))) AS n)
            SELECT 1::BIGINT AS run_id, count(*) AS n_entries, count(*) FILTER (WHERE state IN ('missing', 'partial')) AS n_events, false AS latest FROM plan
            UNION ALL SELECT 2, n, 0, true FROM back""",
        "best_dates": """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_id * 1000 ELSE epoch_ms(date_trunc('second', ts)) END AS date_ms,
            CASE event_id % 4 WHEN 0 THEN 'office_metadata' WHEN 1 THEN 'exif' WHEN 2 THEN 'email_header' ELSE 'filesystem_modified' END AS date_source FROM events""",
        "media_dice": """WITH k AS (SELECT user_id, list(DISTINCT event_type || '-' || (event_id % 7)) AS m FROM events GROUP BY user_id)
            SELECT a.user_id::VARCHAR AS a, (a.user_id + 1)::VARCHAR AS b, 2 * len(list_intersect(a.m, coalesce(b.m, []))) / (len(a.m) + len(coalesce(b.m, []))) AS media_match_score
            FROM k a LEFT JOIN k b ON b.user_id = a.user_id + 1""",
        "scan_summary": f"WITH {FILES} SELECT string_split(path, '/')[1] AS root, count(*) AS n_files, sum(size)::BIGINT AS bytes FROM f GROUP BY 1",
        "ignore_filter": "SELECT doc_id, 'root/keep.txt' AS path FROM documents WHERE doc_id % 5 > 2",
        "scan_union_roots": f"WITH {FILES} SELECT path, size FROM f WHERE size % 2 = 0 OR size % 3 = 0",
        "classify_kinds": """SELECT 'a/file.' || e AS path, lower(CASE e WHEN 'tar.gz' THEN 'gz' ELSE e END) AS extension,
            CASE lower(e) WHEN 'txt' THEN 'plain_text' WHEN 'html' THEN 'html' WHEN 'json' THEN 'json' WHEN 'csv' THEN 'csv' WHEN 'py' THEN 'source_code' WHEN 'docx' THEN 'docx'
              WHEN 'yml' THEN 'yaml' WHEN 'rtf' THEN 'rtf' END AS kind, count(*) AS n
            FROM (SELECT ['txt', 'HTML', 'json', 'csv', 'py', 'docx', 'bin', 'tar.gz', 'YML', 'rtf'][doc_id % 10 + 1] AS e FROM documents) GROUP BY ALL""",
        "size_groups": f"WITH {FILES} SELECT size, count(*) AS n_files FROM f GROUP BY size HAVING count(*) > 1",
        "sample_prefilter": f"""WITH {FILES}, b AS (SELECT path, size, encode(text) AS c FROM f), h AS (SELECT path, size,
            sha256(c[1:65536]) || CASE WHEN size > 131072 THEN sha256(c[size - 65535:size]) ELSE '' END AS s FROM b)
            SELECT path, size FROM (SELECT *, count(*) OVER (PARTITION BY size, s) AS n FROM h) WHERE n > 1""",
        "exact_duplicates": f"WITH {FILES}, {_GROUPS} SELECT *, size * (n_files - 1) AS reclaimable FROM g",
        "dup_representatives": f"WITH {FILES}, {_GROUPS}, {_REPS} SELECT path, size FROM r",
        "analyze_report": f"""WITH {FILES}, {_GROUPS} SELECT (SELECT count(*) FROM f) AS files, (SELECT sum(size)::BIGINT FROM f) AS bytes, count(*) AS groups,
            coalesce(sum(n_files), 0)::BIGINT AS duplicate_files, coalesce(sum(size * (n_files - 1)), 0)::BIGINT AS reclaimable FROM g""",
        "cache_lookup": f"""WITH {FILES}, {_CACHE} SELECT f.path, f.size, f.mtime_ms, CASE WHEN c.size = f.size AND abs(c.mtime_ms - f.mtime_ms) <= 2000 THEN full_hash END AS full_hash
            FROM f LEFT JOIN c ON c.path = f.path""",
        "cache_upsert": f"""WITH {FILES}, {_CACHE}, n AS (SELECT path, size, mtime_ms, md5(text) AS sample_hash FROM f WHERE doc_id % 4 <> 0)
            SELECT coalesce(n.path, c.path) AS path, coalesce(n.size, c.size) AS size, coalesce(n.mtime_ms, c.mtime_ms) AS mtime_ms,
              CASE WHEN n.path IS NULL THEN c.sample_hash ELSE n.sample_hash END AS sample_hash,
              CASE WHEN n.path IS NULL OR (n.size = c.size AND n.mtime_ms = c.mtime_ms) THEN c.full_hash END AS full_hash
            FROM n FULL JOIN c ON n.path = c.path""",
        "token_sets": f"WITH {FILES}, {_TOKENS.replace('SRC', 'f')} SELECT doc_id, count(*) AS n_tokens, min(t) AS least, max(t) AS most FROM k GROUP BY doc_id",
        "coverage_pairs": f"""WITH {FILES}, {_TOKENS.replace('SRC', 'f')}, s AS (SELECT f.doc_id, coalesce(ts, []) AS ts FROM f LEFT JOIN (SELECT doc_id, list(t) AS ts FROM k GROUP BY 1) l ON l.doc_id = f.doc_id)
            SELECT a.doc_id AS a, b.doc_id AS b, CASE WHEN len(a.ts) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.ts, b.ts)) / len(a.ts) END AS a_to_b,
              CASE WHEN len(a.ts) + len(b.ts) > 0 THEN 2 * len(list_intersect(a.ts, b.ts)) / (len(a.ts) + len(b.ts)) END AS dice FROM s a JOIN s b ON b.doc_id = a.doc_id + 1""",
        "similar_pairs": f"WITH RECURSIVE {similar} SELECT a, b, jaccard, a_to_b, b_to_a, relationship FROM pairs",
        "flagged_diverged": f"WITH RECURSIVE {similar} SELECT a, b, jaccard, a_to_b, b_to_a, relationship FROM pairs WHERE relationship = 'diverged'",
        "version_families": f"WITH RECURSIVE {similar}, {_RANKED} SELECT * FROM ranked",
        "collapse_decisions": f"WITH RECURSIVE {similar}, {_RANKED}, {_DECIDED} SELECT * FROM acted",
        "collapse_summary": f"""WITH RECURSIVE {similar}, {_RANKED}, {_DECIDED} SELECT count(*) FILTER (WHERE action = 'keep') AS files_kept, count(*) FILTER (WHERE action <> 'keep') AS files_collapsed,
            coalesce(sum(size) FILTER (WHERE action <> 'keep'), 0)::BIGINT AS bytes_saved, 0::BIGINT AS archived_bytes FROM acted""",
        "apply_collapse": f"""WITH RECURSIVE {similar}, {_RANKED}, {_DECIDED}, {_TREES}, {_PLAN}
            SELECT CASE WHEN action = 'collapse' AND state IN ('missing', 'partial') THEN '_collapsed/' || relative_path ELSE relative_path END AS relative_path, plan.size, state
            FROM plan LEFT JOIN acted ON acted.path = plan.relative_path""",
        "preflight_issues": f"""WITH {FILES} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'illegal_character:?' WHEN 1 THEN 'reserved_name:con.log'
            WHEN 2 THEN 'trailing_dot_or_space:doc_' || doc_id || '.txt ' ELSE 'path_too_long' END AS issues FROM f""",
        "path_collision": f"WITH {FILES} SELECT 'r/' || lower(substring(path, 1, 8)) AS key, count(*) AS n FROM f GROUP BY 1 HAVING count(*) > 1",
        "reconcile_states": f"{plan} SELECT * FROM plan",
        "reconcile_summary": plan + " SELECT " + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in ("verified", "partial", "missing", "moved", "conflict", "blocked", "destination_only")) + " FROM plan",
        "transfer_summary": plan + """ SELECT count(*) FILTER (WHERE state IN ('missing', 'partial')) AS copied, coalesce(sum(size) FILTER (WHERE state IN ('missing', 'partial')), 0)::BIGINT AS bytes_copied, """
        + ", ".join(f"count(*) FILTER (WHERE state = '{s}') AS skipped_{s}" for s in ("verified", "conflict", "blocked", "moved")) + " FROM plan",
        "journal_counts": f"{plan} SELECT 1::BIGINT AS run_id, state, count(*) AS n, count(*) FILTER (WHERE state IN ('moved', 'blocked')) AS n_detail FROM plan GROUP BY state",
        "manifest_files": f"WITH {FILES} SELECT path AS relative_path, sha256(text) AS sha256, size FROM f",
        "manifest_dup_groups": f"WITH {FILES} SELECT sha256(text) AS sha256, any_value(size) AS size, count(*) AS n_files, min(path) AS first_path FROM f GROUP BY 1 HAVING count(*) > 1",
        "verify_diff": diff,
        "integrity_vote": """WITH h AS (SELECT doc_id, CASE WHEN doc_id % 2 <> 0 THEN md5((doc_id % 3)::VARCHAR) END AS a, CASE WHEN doc_id % 3 <> 0 THEN md5((doc_id % 4)::VARCHAR) END AS b,
            CASE WHEN doc_id % 5 <> 0 THEN md5((doc_id % 6)::VARCHAR) END AS c FROM documents) SELECT doc_id, coalesce(a = b, false) OR coalesce(b = c, false) OR coalesce(a = c, false) AS trusted FROM h""",
        "header_dates": """SELECT event_id, epoch_ms(make_timestamp(2021, 2, event_id % 28 + 1, 10, event_id % 60, 7)) - 5400000 AS mail_ms,
            epoch_ms(make_timestamp(2000 + event_id % 30, 3, event_id % 28 + 1, 4, 5, 6)) AS office_ms FROM events""",
    }
