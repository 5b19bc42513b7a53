"""DuckDB SQL for the queries: written from the operators' definitions, for an engine with other regular expressions (no lookaround,
so adjoining matches are replaced twice) and with recursive queries in place of folds."""

from __future__ import annotations

from .plans.provider import GUIDANCE
from .plans.render import NOTE
from .queries import FORM, FUNCTION, KIND, LITERALS, OPENING, PRIORITY, RELATION, RUBRIC, TITLE

_W = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"
_S = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_S = "[^" + _S[1:]
_WORD = r"[\p{L}\p{N}_’''-]*[\p{L}\p{N}_][\p{L}\p{N}_’''-]*"
_NUMBER = "(?:[0-9ivxlcdm]+|one|two|three|four|five|six|seven|eight|nine|ten)"
_OPENERS = "introduction|prologue|preface|foreword|epilogue|conclusion|afterword|appendix|notes|bibliography|references|acknowledgments|acknowledgements|index"
_EXCLUDED = "copyright|contents|table of contents|bibliography|references|works cited|index|notes|endnotes|acknowledg(?:e)?ments?|list of interviews|written correspondence|interviews and written|photo[\\s-]?insert|illustrations|plates|image credits|about the author|unmapped front matter"


def _re(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def words(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, '{_WORD}')) AS BIGINT)"


def strip(x: str) -> str:
    return _re(_re(x, rf"\A{_S}+", ""), rf"{_S}+\z", "")


def _broken(x: str) -> str:
    once = lambda y: _re(y, rf"({_W})[\x{{FFFD}}\x{{FFFE}}]({_W})", r"\1-\2")
    return f"translate({once(once(x))}, chr(65533) || chr(65534), '')"


def _ligatures(x: str) -> str:
    return f"replace(replace({x}, chr(64257), 'fi'), chr(64258), 'fl')"


def normalize(x: str) -> str:
    t = _broken(_ligatures(f"translate({x}, chr(160) || chr(173), ' ')"))
    glued = lambda y: _re(y, rf"(\A|{_N})a([A-Z][a-z]{{3,}})({_N}|\z)", r"\1a \2\3")
    t = f"regexp_replace({_re(t, r'[ \t]+', ' ')}, '\\n[ \\t]+', chr(10), 'g')"
    t = _re(_re(t, rf"\AT{_S}+he({_N}|\z)", r"The\1"), rf"\AD{_S}+uring({_N}|\z)", r"During\1")
    t = _re(glued(glued(t)), r"([A-Z&])Dr\.", r"\1 Dr.")
    return strip(_re(t, rf"{_S}+([,.;:!?])", r"\1"))


def canonical(x: str) -> str:
    t = _re(_re(f"lower({normalize(x)})", r"\A[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+\z", "")
    return _re(t, rf"{_S}+", " ")


def kind(x: str) -> str:
    t = canonical(x)
    opens = lambda w: f"regexp_matches({t}, '\\A(?:{w})({_N}|\\z)')"
    return f"CASE WHEN {opens(_EXCLUDED)} THEN 'exclude' WHEN {opens('introduction|prologue|preface|foreword')} THEN 'front' WHEN {opens('epilogue|conclusion|afterword')} THEN 'ending' ELSE 'body' END"


def kind_by_words(x: str, n: str) -> str:
    return f"CASE WHEN regexp_matches({canonical(x)}, '\\Apart({_N}|\\z)') AND {n} < 50 THEN 'exclude' ELSE {kind(x)} END"


def heading(x: str) -> str:
    end = r"(?:[^\p{L}\p{N}_\n][^\n]*|)"
    branches = [rf"(?:chapter|part){_S}+{_NUMBER}{end}", rf"\p{{Nd}}+{_S}+[A-Z][^\n]{{2,100}}", r"summary of the framework[^\n]*", rf"(?:{_OPENERS}){end}"]
    return rf"regexp_matches({x}, '(?i)\A{_S}*(?:{'|'.join(branches)})\n?\z')"


def main_title(x: str) -> str:
    bare = "introduction|preface|prologue|foreword|conclusion|epilogue|afterword|bibliography|references|index|illustrations|plates"
    return rf"regexp_matches({x}, '(?i)\A(?:(?:{bare})|(?:summary of the framework|list of interviews|written correspondence|photo[- ]insert)[^\n]*|\p{{Nd}}+{_S}+{_NOT_S}[^\n]*)\n?\z')"


def markdown(x: str) -> str:
    return rf"regexp_matches({x}, '\A{_S}{{0,3}}#{{1,6}}{_S}+{_NOT_S}')"


def line(x: str) -> str:
    return strip(_re(_ligatures(f"translate({x}, chr(173) || chr(65533), '')"), rf"{_S}+", " "))


def line_key(x: str) -> str:
    return strip(_re(_re(f"lower({line(x)})", r"\p{Nd}+", "#"), "[^a-z# ]+", ""))


def truncated(x: str, most: int) -> str:
    w, front = f"list_filter(string_split_regex({x}, '{_S}+'), lambda v: v <> '')", most * 2 // 3
    mark = "chr(10) || chr(10) || '(the middle of this text is left out)' || chr(10) || chr(10)"
    return f"CASE WHEN len({w}) <= {most} THEN {x} ELSE array_to_string(({w})[1:{front}], ' ') || {mark} || array_to_string(({w})[{front - most}:], ' ') END"


def label(x: str) -> str:
    return _re(strip(x), rf"(?i)\A{_S}*(?:editorial transition|transition){_S}*:{_S}*", "")


def _literal_rows() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    out = []
    for i, s in enumerate(LITERALS):
        parts = [quoted(p) for p in s.split("\n")]
        text = " || chr(10) || ".join(parts)
        out.append(f"({i}, replace({text}, chr(0), ''))" if "\r" not in s else f"({i}, {text})")
    return f"odd(id, s) AS (SELECT CAST(a AS BIGINT), b FROM (VALUES {', '.join(out)}) v(a, b))"


_LIT = f"{_literal_rows()}, literals AS (SELECT * FROM odd UNION ALL SELECT doc_id + 1000, ({OPENING}) || string_split(text, chr(10))[1] FROM documents)"
_LINES = "lines AS (SELECT source AS book_id, doc_id AS section_no, unnest(generate_series(1, len(string_split(text, chr(10))))) AS idx, unnest(string_split(text, chr(10))) AS line FROM documents)"
_PARAS = f"{_LINES}, paras AS (SELECT * FROM (SELECT book_id, section_no, idx, t AS text, {words('t')} AS word_count FROM (SELECT *, {normalize('line')} AS t FROM lines)) WHERE word_count >= 2)"
_SECS = (
    f"{_PARAS}, totals AS (SELECT book_id, section_no, CAST(sum(word_count) AS BIGINT) AS word_count FROM paras GROUP BY ALL), "
    f"secs AS (SELECT t.*, title, {kind_by_words('title', 'word_count')} AS kind FROM totals t JOIN (SELECT doc_id AS section_no, {TITLE} AS title FROM documents) d USING (section_no))"
)
_ANALYTIC = "(4.0::DOUBLE * unity + 3 * term + 4 * proposition + 4 * support + 3 * objection + 3 * conclusion + 2 * dependency)"
_ARC = "(2.0::DOUBLE * necessity + 2 * importance + turning + density)"
_PENALTY = "(2.0::DOUBLE * redundancy + 2 * detail + 2 * context)"
_NARRATIVE = f"{FORM} IN ('biography_memoir', 'historical_investigative_narrative')"
_SCORE = f"({_ANALYTIC} * CASE WHEN {_NARRATIVE} THEN 0.8::DOUBLE ELSE 1 END + {_ARC} * CASE WHEN {_NARRATIVE} THEN 1.4::DOUBLE ELSE 1 END + readability - {_PENALTY})"
_TAG = lambda when, n: f"CASE WHEN {when} THEN ['R' || CAST({n} AS VARCHAR)] ELSE CAST([] AS VARCHAR[]) END"
_BLOCKS = (
    f"rubric AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in RUBRIC.items())} FROM documents), "
    "blocks AS (SELECT source AS book_id, 'K' || doc_id AS block_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS cand_pos, (doc_id // 20) % 6 AS section_no, doc_id AS first_index, "
    f"doc_id + doc_id % 45 AS last_index, {words('text')} AS word_count, {FUNCTION} AS block_function, {_SCORE} AS score, {_TAG('doc_id % 3 = 0', 'doc_id // 200 * 10 + doc_id % 10')} AS covers, "
    f"{_TAG('doc_id % 4 = 1', 'doc_id // 200 * 10 + doc_id % 7')} AS terms, {_TAG('doc_id % 5 = 2', 'doc_id // 200 * 10 + doc_id % 10')} AS supports, "
    "CASE WHEN doc_id % 6 = 5 THEN ['K' || (doc_id - 20)] ELSE CAST([] AS VARCHAR[]) END AS redundant_with, doc_id FROM rubric)"
)
_PRIORITIES = f"priorities AS (SELECT source AS book_id, (d.doc_id // 20) % 6 AS section_no, arg_max({PRIORITY}, d.doc_id) AS priority FROM labels l JOIN documents d USING (doc_id) GROUP BY ALL)"
_UTILITY = (
    "CASE coalesce(priority, 'medium') WHEN 'high' THEN 1.18::DOUBLE WHEN 'low' THEN 0.86::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN block_function IN ('setup', 'turning_point', 'consequence', 'interpretation', 'conclusion') "
    "THEN 1.07::DOUBLE ELSE 1 END * (1.0::DOUBLE + 0.04::DOUBLE * len(list_distinct(list_concat(list_concat(covers, terms), supports)))) * score / sqrt(greatest(word_count, 1)::DOUBLE)"
)
_CANDIDATES = f"{_BLOCKS}, {_PRIORITIES}, candidates AS (SELECT b.*, coalesce(priority, 'medium') AS priority, round({_UTILITY}, 6) AS utility FROM blocks b LEFT JOIN priorities p USING (book_id, section_no))"
_BSECS = "bsecs AS (SELECT book_id, section_no, CAST(sum(word_count) AS BIGINT) AS word_count, CASE section_no WHEN 0 THEN 'front' WHEN 5 THEN 'ending' ELSE 'body' END AS kind FROM blocks GROUP BY book_id, section_no)"
_TARGETS = "targets AS (SELECT book_id, CAST(trunc(sum(word_count)::DOUBLE * 0.25::DOUBLE) AS BIGINT) AS target FROM bsecs GROUP BY book_id)"
_CAPS = "caps AS (SELECT book_id, section_no, greatest(600, CAST(trunc(target::DOUBLE * (word_count::DOUBLE / sum(word_count) OVER (PARTITION BY book_id))) AS BIGINT)) AS cap FROM bsecs JOIN targets USING (book_id) WHERE word_count > 0)"
_REQS = (
    f"reqs AS (SELECT source AS book_id, pos, 'R' || pos AS requirement_id, {KIND} AS kind, 'about ' || doc_id AS description, CASE WHEN pos % 2 = 0 THEN 'essential' ELSE 'important' END AS importance, "
    "['C' || doc_id % 4, 'C' || pos % 3] AS claims, CASE WHEN doc_id % 6 = 0 THEN CAST([] AS VARCHAR[]) ELSE ['S' || doc_id % 5] END AS sections, (pos % 2 = 0 OR pos = 5) AS must "
    "FROM (SELECT *, doc_id // 20 AS pos FROM documents))"
)
_RELS = f"rels AS (SELECT source AS book_id, pos, 'R' || pos AS source, 'R' || (pos - pos % 11 + (pos * 3 + 7) % 11) AS target, {RELATION} AS relation FROM (SELECT *, doc_id // 20 AS pos FROM documents) WHERE source <> 'src4')"
_PATH = "path AS (SELECT source AS book_id, pos, 'R' || (pos - pos % 12 + (pos * 4 + 8) % 12) AS requirement_id FROM (SELECT *, doc_id // 20 AS pos FROM documents))"
_GOALS = (
    f"{_REQS}, {_PATH}, firsts AS (SELECT book_id, requirement_id, min(pos) AS p FROM path GROUP BY ALL), "
    "goals AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY p NULLS LAST, pos) AS ord, requirement_id FROM reqs LEFT JOIN firsts USING (book_id, requirement_id) WHERE must)"
)
_MORE = lambda by, x: f"[CASE WHEN i = {x}.section_no THEN {by}[i + 1] + {x}.word_count ELSE {by}[i + 1] END FOR i IN range(6)]"
# the selection: passes 1 to 3 are one fold over ordered tries (a goal's or a section's end with the first success), pass 4 is another
_CHOICE = (
    f"{_CANDIDATES}, {_BSECS}, {_TARGETS}, {_CAPS}, {_GOALS}, capped AS (SELECT c.*, coalesce(cap, 600) AS cap, target FROM candidates c LEFT JOIN caps USING (book_id, section_no) JOIN targets USING (book_id)), "
    "tries AS (SELECT c.*, 1 AS pass, ord AS o, requirement_id AS goal FROM goals g JOIN capped c ON c.book_id = g.book_id AND list_contains(list_concat(c.covers, c.terms), g.requirement_id) "
    "UNION ALL SELECT c.*, 2, section_no, 'S' || section_no FROM capped c UNION ALL SELECT c.*, 3, 0, NULL FROM capped c), "
    "steps AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY pass, o, utility DESC, CASE WHEN pass < 3 THEN word_count ELSE 0 END, cand_pos) AS k FROM tries), "
    "pick AS (SELECT book_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS used, [CAST(0 AS BIGINT) FOR i IN range(6)] AS by_, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS guarded, CAST([] AS VARCHAR[]) AS done, CAST([] AS VARCHAR[]) AS tags FROM targets UNION ALL "
    f"SELECT p.book_id, s.k, CASE WHEN good THEN p.used + s.word_count ELSE p.used END, CASE WHEN good THEN {_MORE('p.by_', 's')} ELSE p.by_ END, CASE WHEN good THEN list_append(p.ids, s.block_id) ELSE p.ids END, "
    "CASE WHEN good AND s.pass < 3 THEN list_append(p.guarded, s.block_id) ELSE p.guarded END, CASE WHEN hit THEN list_append(p.done, s.goal) ELSE p.done END, CASE WHEN hit AND s.pass = 1 THEN list_append(p.tags, s.block_id || ' ' || s.goal) ELSE p.tags END "
    "FROM pick p JOIN steps s ON s.book_id = p.book_id AND s.k = p.k + 1, LATERAL (SELECT list_contains(p.ids, s.block_id) AS has, coalesce(list_contains(p.done, s.goal), false) AS was) a, LATERAL (SELECT NOT has AND CASE s.pass "
    "WHEN 3 THEN NOT list_has_any(p.ids, s.redundant_with) AND p.used + s.word_count <= s.target AND p.by_[s.section_no + 1] + s.word_count <= s.cap "
    "ELSE NOT was AND (s.pass = 1 OR p.by_[s.section_no + 1] = 0) AND p.used + s.word_count <= trunc(s.target::DOUBLE * 1.12::DOUBLE) END AS good) b, LATERAL (SELECT s.pass < 3 AND NOT was AND (good OR (s.pass = 1 AND has)) AS hit) c), "
    "third AS (SELECT * FROM pick QUALIFY k = max(k) OVER (PARTITION BY book_id)), "
    "rest AS (SELECT c.*, row_number() OVER (PARTITION BY c.book_id ORDER BY abs(t.used + c.word_count - c.target), utility DESC, cand_pos) AS k FROM capped c JOIN third t USING (book_id) "
    "WHERE t.used < trunc(c.target::DOUBLE * 0.94::DOUBLE) AND NOT list_contains(t.ids, c.block_id) AND NOT list_has_any(t.ids, c.redundant_with)), "
    "late AS (SELECT book_id, CAST(0 AS BIGINT) AS k, used, by_, ids, false AS stop FROM third UNION ALL "
    f"SELECT l.book_id, r.k, u, CASE WHEN good THEN {_MORE('l.by_', 'r')} ELSE l.by_ END, CASE WHEN good THEN list_append(l.ids, r.block_id) ELSE l.ids END, u >= trunc(r.target::DOUBLE * 0.97::DOUBLE) "
    "FROM late l JOIN rest r ON r.book_id = l.book_id AND r.k = l.k + 1, LATERAL (SELECT NOT list_contains(l.ids, r.block_id) AND NOT list_has_any(l.ids, r.redundant_with) AND l.used + r.word_count <= trunc(r.target::DOUBLE * 1.03::DOUBLE) "
    "AND l.by_[r.section_no + 1] + r.word_count <= r.cap AS good) a, LATERAL (SELECT CASE WHEN good THEN l.used + r.word_count ELSE l.used END AS u) b WHERE NOT l.stop), "
    "final AS (SELECT book_id, arg_max(ids, k) AS ids FROM late GROUP BY book_id), "
    "choice AS (SELECT c.*, row_number() OVER (PARTITION BY book_id ORDER BY section_no, first_index, cand_pos) AS reading_pos, list_contains(t.guarded, block_id) AS protected, "
    "array_to_string([split_part(x, ' ', 2) FOR x IN t.tags IF split_part(x, ' ', 1) = block_id], ',') AS protected_for FROM capped c JOIN final f USING (book_id) JOIN third t USING (book_id) WHERE list_contains(f.ids, block_id))"
)
_GAPS = (
    "gaps AS (SELECT book_id, before_id, after_id, pos FROM (SELECT book_id, block_id AS before_id, section_no, last_index, reading_pos AS pos, lead(block_id) OVER w AS after_id, lead(section_no) OVER w AS ns, "
    "lead(first_index) OVER w AS nf FROM choice WINDOW w AS (PARTITION BY book_id ORDER BY reading_pos)) WHERE after_id IS NOT NULL AND (section_no <> ns OR nf > last_index + 1))"
)
_PROPOSALS = (
    f"p0 AS (SELECT *, CASE WHEN pos % 3 = 0 THEN 'Transition: ' ELSE '' END || CASE WHEN pos % 7 = 0 THEN '  ' ELSE 'leads on to ' || after_id END AS text, pos % 5 <> 0 AS necessary FROM gaps), "
    "p1 AS (SELECT * FROM p0 UNION ALL SELECT book_id, before_id, after_id, pos + 1000, text || ' again', necessary FROM p0 WHERE pos % 4 = 1), "
    f"p2 AS (SELECT book_id, before_id, after_id, min(pos) AS pos, arg_max({label('text')}, pos) AS text FROM p1 WHERE necessary AND {strip('text')} <> '' GROUP BY ALL)"
)
_LINK = "10 * len(list_intersect({0}.sections, {1}.sections)) + 5 * len(list_intersect({0}.claims, {1}.claims))"
_ORPHANS = "orphans AS (SELECT * FROM reqs q WHERE kind = 'major_proposition' AND must AND NOT EXISTS (SELECT 1 FROM rels r WHERE r.book_id = q.book_id AND r.target = q.requirement_id AND r.relation = 'supports'))"
_REPAIR = (
    f"{_REQS}, {_RELS}, {_ORPHANS}, supports AS (SELECT * FROM reqs WHERE kind IN ('supporting_argument', 'evidence')), "
    f"ranked AS (SELECT o.book_id, o.pos, o.requirement_id, s.requirement_id AS source, {_LINK.format('o', 's')} AS link, row_number() OVER (PARTITION BY o.book_id, o.pos ORDER BY {_LINK.format('o', 's')} DESC, s.pos) AS k FROM orphans o JOIN supports s USING (book_id)), "
    "added AS (SELECT book_id, pos, source, requirement_id AS target, link = 0 AS weak FROM ranked WHERE k = 1 UNION ALL SELECT book_id, pos, 'auto-support-for-' || requirement_id, requirement_id, false FROM orphans o WHERE NOT EXISTS (SELECT 1 FROM supports s WHERE s.book_id = o.book_id)), "
    "edges AS (SELECT book_id, pos, source, target, relation, false AS weak FROM rels UNION ALL SELECT book_id, coalesce((SELECT max(pos) FROM rels r WHERE r.book_id = a.book_id), 0) + row_number() OVER (PARTITION BY book_id ORDER BY pos), source, target, 'supports', weak FROM added a), "
    "made AS (SELECT book_id, (SELECT max(pos) FROM reqs q WHERE q.book_id = o.book_id) + row_number() OVER (PARTITION BY book_id ORDER BY pos) AS pos, 'auto-support-for-' || requirement_id AS requirement_id, 'supporting_argument' AS kind, 'essential' AS importance, true AS must FROM orphans o WHERE NOT EXISTS (SELECT 1 FROM supports s WHERE s.book_id = o.book_id)), "
    "allreqs AS (SELECT book_id, pos, requirement_id, kind, importance, must FROM reqs UNION ALL SELECT * FROM made)"
)
_PAGE_LINES = (
    f"{_LINES}, plines AS (SELECT book_id, section_no AS page_no, idx AS line_no, line AS text FROM lines UNION ALL SELECT book_id, section_no, 0, 'Chapter Header ' || section_no FROM lines WHERE idx = 1 "
    "UNION ALL SELECT book_id, section_no, max(idx) + 1, CASE WHEN section_no % 2 = 0 THEN 'page ' || section_no ELSE 'Odd: ' || section_no || ' !' END FROM lines GROUP BY book_id, section_no)"
)


def _noise(table: str) -> str:
    return (
        f"keyed AS (SELECT book_id, page_no, {line_key('text')} AS key, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS down, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no DESC) AS up FROM {table}), "
        "ends AS (SELECT book_id, key FROM keyed WHERE down <= 3 UNION ALL SELECT book_id, key FROM keyed WHERE up <= 4), npages AS (SELECT book_id, count(DISTINCT page_no) AS pages FROM keyed GROUP BY book_id), "
        "noise AS (SELECT book_id, key FROM ends JOIN npages USING (book_id) WHERE key <> '' AND length(key) <= 100 GROUP BY book_id, key, pages HAVING count(*) >= greatest(3, trunc(pages * 0.06::DOUBLE)))"
    )


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


def _cleaned(key: str, keep: str) -> str:
    """Page blocks as prose: from ls (key, k, l) to cleaned (key, text). keep: the condition on a line l of n that is no noise."""
    return (
        f"n AS (SELECT {key}, k, {line('l')} AS l FROM ls), "
        f"kept AS (SELECT {key}, l, row_number() OVER (PARTITION BY {key} ORDER BY k) AS k FROM n WHERE l <> '' AND NOT regexp_matches(l, '\\A\\p{{Nd}}+\\z') AND {keep}), "
        f"joined AS (SELECT {key}, string_agg(CASE WHEN k = 1 THEN '' WHEN hy AND lo THEN '' ELSE ' ' END || CASE WHEN cut THEN l[:-2] ELSE l END, '' ORDER BY k) AS t FROM (SELECT *, lag(l) OVER w LIKE '%-' AS hy, regexp_matches(l, '\\A\\p{{Ll}}') AS lo, "
        f"l LIKE '%-' AND coalesce(regexp_matches(lead(l) OVER w, '\\A\\p{{Ll}}'), false) AS cut FROM kept WINDOW w AS (PARTITION BY {key} ORDER BY k)) GROUP BY {key}), "
        f"cleaned AS (SELECT {key}, {normalize(_re(_re('t', f'({_W}){_S}*[-‐‑]{_S}+({_W})', chr(92) + '1-' + chr(92) + '2'), f'{_S}+([,.;:!?])', chr(92) + '1'))} AS text FROM joined)"
    )


_HEADINGS = (
    f"{_PAGE_LINES}, pl AS (SELECT book_id, page_no, line_no, CASE WHEN line_no = 2 AND page_no % 40 < 20 THEN 'Chapter ' || page_no || ': ' || substr(text, 1, 12) ELSE text END AS text FROM plines), {_noise('pl')}, "
    f"top AS (SELECT *, {line('text')} AS l, row_number() OVER (PARTITION BY book_id, page_no ORDER BY line_no) AS k FROM pl), "
    f"hit AS (SELECT t.book_id, page_no, l, k FROM top t WHERE k <= 12 AND l <> '' AND length(l) <= 140 AND ({main_title('l')} OR {heading('l')}) AND NOT EXISTS (SELECT 1 FROM noise n WHERE n.book_id = t.book_id AND n.key = {line_key('l')})), "
    "one AS (SELECT book_id, page_no AS start_page, arg_min(l, k) AS title FROM hit GROUP BY ALL), headings AS (SELECT book_id, start_page, title FROM (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM one) WHERE n >= 3)"
)


_OUTLINE = (
    f"outline AS (SELECT source AS book_id, doc_id AS pos, doc_id // 10 + 1 AS start_page, CASE WHEN doc_id % 7 = 0 THEN doc_id // 10 + 3 END AS end_page, {TITLE} AS title FROM documents), "
    "np AS (SELECT source AS book_id, max(doc_id // 10) - 2 AS pages FROM documents GROUP BY source), "
    "ranges AS (SELECT book_id, pos, title, start_page, least(coalesce(nullif(end_page, 0), nxt - 1, pages), pages) AS end_page FROM (SELECT *, lead(start_page) OVER (PARTITION BY book_id ORDER BY pos) AS nxt FROM outline) JOIN np USING (book_id)), "
    "pranges AS (SELECT * FROM ranges WHERE start_page <= end_page)"
)
_KEPT = f"{_PARAS}, kept AS (SELECT *, idx - row_number() OVER (PARTITION BY section_no ORDER BY idx) AS island FROM paras WHERE (idx * 7 + section_no) % 4 <> 0), runs AS (SELECT *, dense_rank() OVER (PARTITION BY section_no ORDER BY island) AS run FROM kept)"
# sections are numbered over documents with a block of `least` words; those without one of two words are gaps
_FILES = (
    f"WITH l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT source, doc_id, {words(normalize('line')).replace('{', '{{').replace('}', '}}')} AS n FROM l), "
    "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS k FROM (SELECT {key} AS book_id, doc_id, count(*) FILTER (n >= 2) AS paragraphs, CAST(sum(n) FILTER (n >= 2) AS BIGINT) AS word_count FROM p WHERE n >= {least} GROUP BY ALL)) WHERE paragraphs > 0), "
    f"t AS (SELECT s.*, {normalize(TITLE).replace('{', '{{').replace('}', '}}')} AS title FROM s) "
    f"SELECT book_id, printf('CH%03d', k) AS section_id, title, {kind_by_words('title', 'word_count').replace('{', '{{').replace('}', '}}')} AS kind, paragraphs, word_count FROM t"
)

#: Sections of archives by contents: members of two documents, each fifth one going on with the section before it, and the last one under
#: its landmark where there is a navigation document (archives of even number).
_CONTENTS = (
    f"l AS (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), p AS (SELECT source, doc_id, {words(normalize('line'))} AS n FROM l), "
    f"d AS (SELECT source || '-' || doc_id // 200 AS book_id, doc_id, {normalize(TITLE)} AS title, count(*) FILTER (n >= 2) AS paragraphs, CAST(coalesce(sum(n) FILTER (n >= 2), 0) AS BIGINT) AS words FROM p GROUP BY source, doc_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) - 1 AS k FROM d), "
    f"m AS (SELECT *, {kind('title')} = 'exclude' AS gone, k // 2 AS member, max(k // 2) OVER (PARTITION BY book_id) AS last, doc_id // 200 % 2 = 0 AS marked FROM r), "
    "f AS (SELECT *, first_value(title) OVER w AS first, first_value(gone) OVER w AS first_gone, marked AND member = last AS landmark, sum(paragraphs) OVER (w ROWS UNBOUNDED PRECEDING) = paragraphs AS leads FROM m WINDOW w AS (PARTITION BY book_id, member ORDER BY doc_id)), "
    "o AS (SELECT *, CASE WHEN landmark THEN leads ELSE member % 5 <> 3 END AS opens, "
    "CASE WHEN landmark AND first_gone THEN first WHEN landmark THEN 'Notes: ' || first WHEN k % 2 = 1 AND first_gone AND NOT gone THEN first || ': ' || title ELSE title END AS label FROM f WHERE paragraphs > 0), "
    "g AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY book_id ORDER BY doc_id) AS part FROM o), "
    "s AS (SELECT book_id, CASE WHEN part = 0 THEN 'Unmapped front matter' ELSE arg_min(label, doc_id) END AS title, CAST(sum(paragraphs) AS BIGINT) AS paragraphs, CAST(sum(words) AS BIGINT) AS word_count, part FROM g GROUP BY book_id, part)"
)

ORACLE_SQL: dict[str, str] = {
    "word_count_doc": f"SELECT doc_id, {words('text')} AS words FROM documents",
    "normalize_docs": f"SELECT doc_id, {normalize('text')} AS text FROM documents",
    "normalize_literals": _with(_LIT, f"SELECT id, {normalize('s')} AS s, {words('s')} AS words FROM literals"),
    "paragraph_lines": _with(_PARAS, "SELECT section_no, idx, text, word_count FROM paras"),
    "blankline_split": _with(
        f"{_LIT}, parts AS (SELECT id, unnest(string_split_regex(regexp_replace(s, '\\r\\n?', chr(10), 'g'), '\\n{_S}*\\n+')) AS b FROM literals), "
        f"clean AS (SELECT id, {normalize(_re('b', chr(92) + 'n+', ' '))} AS text FROM parts)",
        f"SELECT id, row_number() OVER (PARTITION BY id) - 1 AS pos, text FROM clean WHERE {words('text')} >= 2",
    ),
    "canonical_titles": _with(_LIT, f"SELECT id, {canonical('s')} AS title FROM literals"),
    "classify_section": f"SELECT doc_id, {kind('title')} AS kind FROM (SELECT doc_id, {TITLE} AS title FROM documents)",
    "classify_literals": _with(_LIT, f"SELECT id, {kind('s')} AS kind FROM literals"),
    "short_part_rule": _with(_SECS, "SELECT section_no, kind, word_count FROM secs"),
    "heading_predicate": _with(_LIT, f"SELECT id, {heading('s')} AS heading, {main_title('s')} AS main_title, {markdown('s')} AS markdown FROM literals"),
    "slug_ids": "SELECT doc_id, printf('CH%03d', doc_id) AS section_id, printf('-P%04d', doc_id) AS paragraph_id FROM documents",
    "dir_slug": _with(
        f"{_LIT}, t AS (SELECT id, substr({_re(_re(_re(_re(strip('s'), '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_.-]+', '-'), chr(92) + 'A[-._]+', ''), '[-._]+' + chr(92) + 'z', ''), '-{2,}', '-')}, 1, 80) AS slug FROM literals)",
        "SELECT id, CASE WHEN slug = '' THEN 'book' ELSE slug END AS slug FROM t",
    ),
    "truncate_words": f"SELECT doc_id, {truncated('text', 100)} AS text FROM documents",
    "block_preview": f"SELECT doc_id, {truncated('text', 180)} AS text FROM documents",
    "page_line_keys": _with(_LINES, f"SELECT section_no, idx, {line('line')} AS line, {line_key('line')} AS key FROM lines"),
    "transition_labels": _with(_LIT, f"SELECT id, {label('s')} AS s, replace(s, '|', '\\|') AS cell, replace(replace(replace(translate({normalize('s')}, chr(8232) || chr(8233), '  '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS safe FROM literals"),
    "kind_titles": _with(_REQS, "SELECT book_id, requirement_id, array_to_string(list_transform(string_split(kind, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS kind FROM reqs"),
    "link_scores": _with(_REQS, f"SELECT a.book_id, a.pos, CAST({_LINK.format('a', 'b')} AS BIGINT) AS link FROM reqs a JOIN reqs b ON a.book_id = b.book_id AND b.pos = a.pos + 1"),
    "passage_ranges": "SELECT doc_id, 'CH001, CH001-P0001-CH001-P0004' || CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN ', p. ' || doc_id ELSE ', pp. ' || doc_id || '-' || doc_id + 2 END AS range FROM documents",
    "section_totals": _with(_SECS, "SELECT book_id, section_no, word_count FROM secs"),
    "book_totals": _with(_SECS, "SELECT book_id, CAST(coalesce(sum(word_count) FILTER (kind <> 'exclude'), 0) AS BIGINT) AS total_words FROM secs GROUP BY book_id"),
    "structure_gates": _with(
        f"{_SECS}, per AS (SELECT book_id, count(*) FILTER (kind <> 'exclude' AND word_count > 0) AS included, CAST(coalesce(sum(word_count) FILTER (kind <> 'exclude'), 0) AS BIGINT) AS total_words, "
        "CAST(coalesce(sum(word_count) FILTER (kind = 'exclude'), 0) AS BIGINT) AS excluded_words FROM secs GROUP BY book_id), go AS (SELECT source AS book_id, max(doc_id) % 3 = 0 AS stop FROM documents GROUP BY source)",
        "SELECT book_id, included, total_words, excluded_words, array_to_string(list_filter([CASE WHEN stop THEN 'low confidence' END, CASE WHEN total_words <= 0 THEN 'no included words' END, CASE WHEN total_words > 30000 AND included < 3 THEN 'too few sections' END, "
        "CASE WHEN total_words + excluded_words > 0 AND excluded_words::DOUBLE / greatest(total_words + excluded_words, 1) > 0.5 THEN 'mostly excluded' END], lambda x: x IS NOT NULL), '; ') AS violations FROM per JOIN go USING (book_id)",
    ),
    "heading_segments": _with(
        f"{_LINES}, titled AS (SELECT l.*, title FROM lines l JOIN (SELECT doc_id AS section_no, {TITLE} AS title FROM documents) USING (section_no)), "
        "mixed AS (SELECT section_no, idx * 10 AS line_no, line FROM lines UNION ALL SELECT section_no, 5, title FROM titled WHERE idx = 1 AND section_no % 4 > 0 UNION ALL SELECT section_no, idx * 10 + 1, '# Notes' FROM lines WHERE idx % 7 = 0), "
        f"marked AS (SELECT *, {strip(_re(strip('line'), chr(92) + 'A#+', ''))} AS bare FROM mixed), flagged AS (SELECT *, ({markdown('line')} OR (length(bare) < 120 AND {heading('bare')})) AS h FROM marked), "
        "seg AS (SELECT *, CAST(sum(h::INT) OVER (PARTITION BY section_no ORDER BY line_no) AS BIGINT) AS s FROM flagged), "
        f"parts AS (SELECT section_no, s, max(bare) FILTER (h) AS title, {strip('coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT h), ' + chr(39) * 2 + ')')} AS text FROM seg GROUP BY section_no, s), "
        "full_ AS (SELECT section_no, s, coalesce(title, 'Opening') AS title, text FROM parts WHERE text <> ''), "
        "bare_ AS (SELECT section_no, 0 AS s, 'Book text' AS title, string_agg(line, chr(10) ORDER BY line_no) AS text FROM mixed WHERE section_no NOT IN (SELECT section_no FROM full_) GROUP BY section_no)",
        "SELECT CAST(section_no AS VARCHAR) AS book_id, row_number() OVER (PARTITION BY section_no ORDER BY s) AS section_pos, title, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT * FROM full_ UNION ALL SELECT * FROM bare_)",
    ),
    "paragraph_ids": _with(
        f"{_LINES}, raw AS (SELECT book_id, dense_rank() OVER (PARTITION BY book_id ORDER BY section_no) AS n, idx, {normalize('CASE WHEN idx % 5 = 0 THEN ' + chr(39) + '.' + chr(39) + ' ELSE line END')} AS t FROM lines)",
        f"SELECT book_id, printf('CH%03d', n) AS section_id, printf('CH%03d-P%04d', n, idx) AS paragraph_id, idx, {words('t')} AS word_count FROM raw WHERE t <> '' AND {words('t')} >= 2",
    ),
    "chunk_bins": _with(
        f"turns AS (SELECT conv_id, turn, {words('text')} AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations), "
        "bins AS (SELECT conv_id, turn, words, k, CAST(1 AS BIGINT) AS chunk, words AS used FROM turns WHERE k = 1 UNION ALL SELECT t.conv_id, t.turn, t.words, t.k, CASE WHEN used + t.words > 60 THEN chunk + 1 ELSE chunk END, CASE WHEN used + t.words > 60 THEN t.words ELSE used + t.words END "
        "FROM bins b JOIN turns t ON t.conv_id = b.conv_id AND t.k = b.k + 1)",
        "SELECT conv_id, turn, words, chunk FROM bins",
        True,
    ),
    "batch_keys": _with(_BLOCKS, "SELECT book_id, block_id, (cand_pos - 1) // 20 AS batch FROM blocks"),
    "contiguous_runs": _with(_KEPT, "SELECT section_no, idx, run FROM runs"),
    "run_blocks": _with(
        f"{_KEPT}, per AS (SELECT section_no, run, string_agg(printf('P%04d', idx), ',' ORDER BY idx) AS ids, CAST(sum(word_count) AS BIGINT) AS word_count, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY idx)) AS BIGINT) AS n_chars FROM runs GROUP BY section_no, run)",
        "SELECT section_no, run, ids, word_count, 'why' || CASE WHEN count(*) OVER (PARTITION BY section_no) > 1 THEN ' (run ' || run || ' of ' || count(*) OVER (PARTITION BY section_no) || ' of a passage with gaps)' ELSE '' END AS reason, n_chars FROM per",
    ),
    "overview_excerpt": _with(
        f"{_SECS}, has AS (SELECT book_id, count(*) FILTER (kind = 'front') AS fronts, count(*) FILTER (kind = 'ending') AS ends, min(section_no) FILTER (kind = 'body') AS first, max(section_no) FILTER (kind = 'body') AS last FROM secs GROUP BY book_id), "
        "picked AS (SELECT book_id, section_no, 'front' AS part FROM secs JOIN has USING (book_id) WHERE kind = 'front' OR (fronts = 0 AND section_no = first) UNION ALL SELECT book_id, section_no, 'ending' FROM secs JOIN has USING (book_id) WHERE kind = 'ending' OR (ends = 0 AND section_no = last)), "
        "lim AS (SELECT *, greatest(1000, 24000 // count(*) OVER (PARTITION BY book_id)) AS most FROM picked)",
        "SELECT book_id, part, section_no, idx, word_count FROM (SELECT l.book_id, part, section_no, idx, word_count, most, sum(word_count) OVER (PARTITION BY l.book_id, part, section_no ORDER BY idx) AS so_far FROM lim l JOIN paras USING (book_id, section_no)) WHERE so_far <= most",
    ),
    "section_caps": _with(
        f"{_SECS}, pr AS (SELECT doc_id AS section_no, {PRIORITY} AS priority FROM labels), inc AS (SELECT * FROM secs WHERE kind <> 'exclude' AND word_count > 0), t AS (SELECT book_id, trunc(sum(word_count)::DOUBLE * 0.25::DOUBLE) AS target FROM inc GROUP BY book_id), "
        "c AS (SELECT book_id, section_no, greatest(600, CAST(trunc(target * (word_count::DOUBLE / sum(word_count) OVER (PARTITION BY book_id))) AS BIGINT)) AS cap FROM inc JOIN t USING (book_id))",
        "SELECT book_id, section_no, CAST(CASE WHEN priority = 'high' THEN trunc(cap * 1.15::DOUBLE) ELSE cap END AS BIGINT) AS cap FROM c LEFT JOIN pr USING (section_no)",
    ),
    "margin_noise": _with(f"{_PAGE_LINES}, {_noise('plines')}", "SELECT book_id, key FROM noise"),
    "clean_blocks": _with(
        r"raw AS (SELECT doc_id, regexp_replace(text, '([a-z])( )([a-z]{5})', '\1-' || chr(10) || '\3', 'g') || chr(10) || '17' || chr(10) || 'Page 12' || chr(10) || 'end - of' AS t FROM documents), "
        f"ls AS (SELECT doc_id, unnest(generate_series(1, len(string_split(t, chr(10))))) AS k, unnest(string_split(t, chr(10))) AS l FROM raw), {_cleaned('doc_id', f"{line_key('l')} <> 'page #'")}",
        "SELECT doc_id, text FROM cleaned",
    ),
    "outline_levels": _with(
        f"o AS (SELECT source AS book_id, doc_id AS pos, doc_id % 3 AS level, {normalize(TITLE)} AS title, doc_id % 90 + 1 AS start_page FROM documents), k AS (SELECT *, count(*) OVER l AS n, min(pos) OVER l AS f FROM o WHERE {main_title('title')} WINDOW l AS (PARTITION BY book_id, level)), "
        "b AS (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY n >= 3 DESC, CASE WHEN n >= 3 THEN n END DESC, CASE WHEN n >= 3 THEN f END) AS r FROM k), u AS (SELECT book_id, title, start_page, min(pos) AS p FROM b WHERE r = 1 GROUP BY ALL)",
        "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY start_page, p) AS pos, title, start_page FROM u",
    ),
    "page_headings": _with(_HEADINGS, "SELECT book_id, start_page, title FROM headings"),
    "page_book_sections": _with(
        f"{_HEADINGS}, np AS (SELECT book_id, max(page_no) AS pages FROM pl GROUP BY book_id), "
        "starts AS (SELECT book_id, title, start_page, least(coalesce(lead(start_page) OVER (PARTITION BY book_id ORDER BY start_page) - 1, pages), pages) AS end_page FROM headings JOIN np USING (book_id)), "
        f"ls AS (SELECT book_id, page_no, line_no AS k, text AS l FROM pl), {_cleaned('book_id, page_no', f"NOT EXISTS (SELECT 1 FROM noise x WHERE x.book_id = n.book_id AND x.key = {line_key('l')})")}, "
        f"c AS (SELECT book_id, page_no, {words('text')} AS words FROM cleaned)",
        "SELECT s.book_id, start_page AS section_pos, title, count(*) AS blocks, CAST(sum(words) AS BIGINT) AS words FROM starts s JOIN c ON c.book_id = s.book_id AND page_no BETWEEN start_page AND end_page WHERE words >= 3 GROUP BY ALL",
    ),
    "page_ranges": _with(_OUTLINE, "SELECT book_id, pos, title, start_page, end_page FROM pranges"),
    "page_range_join": _with(_OUTLINE, "SELECT r.book_id, r.pos AS section_pos, count(*) AS blocks, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM pranges r JOIN documents d ON d.source = r.book_id AND d.doc_id // 10 BETWEEN r.start_page AND r.end_page GROUP BY r.book_id, r.pos"),
    "rubric_score": _with(_BLOCKS, "SELECT book_id, block_id, round(score, 6) AS score FROM blocks"),
    "score_join_default": _with(
        f"{_BLOCKS}, s AS (SELECT book_id, block_id, doc_id AS seq, score FROM blocks WHERE doc_id % 3 > 0 UNION ALL SELECT book_id, block_id, doc_id + 1, score + 1 FROM blocks WHERE doc_id % 3 > 0 AND doc_id % 5 = 0), l AS (SELECT book_id, block_id, arg_max(score, seq) AS score FROM s GROUP BY ALL)",
        "SELECT b.book_id, b.block_id, round(coalesce(l.score, 10.0), 6) AS score FROM blocks b LEFT JOIN l USING (book_id, block_id)",
    ),
    "priority_join": _with(_CANDIDATES, "SELECT book_id, block_id, priority FROM candidates"),
    "utility_rank": _with(_CANDIDATES, "SELECT book_id, block_id, utility, row_number() OVER (PARTITION BY book_id ORDER BY utility DESC, cand_pos) AS rank FROM candidates"),
    "residual_order": _with(_CANDIDATES, "SELECT book_id, block_id, row_number() OVER (PARTITION BY book_id ORDER BY abs(900 + word_count - 1500), utility DESC, cand_pos) AS rank FROM candidates"),
    "top_alternatives": _with(_CANDIDATES, "SELECT book_id, block_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY round(score, 6) DESC, cand_pos) AS rank FROM candidates WHERE doc_id % 3 > 0) WHERE rank <= 10"),
    "anchor_order": _with(_CANDIDATES, "SELECT book_id, section_no, block_id, row_number() OVER (PARTITION BY book_id, section_no ORDER BY utility DESC, word_count, cand_pos) AS rank FROM candidates"),
    "coverage_mode": _with(f"{_BLOCKS}, {_BSECS}, {_PRIORITIES}", "SELECT book_id, section_no, kind IN ('front', 'ending') OR coalesce(priority, 'medium') IN ('high', 'medium') AS required FROM bsecs LEFT JOIN priorities USING (book_id, section_no)"),
    "value_pass": _with(
        f"{_CANDIDATES}, {_BSECS}, {_TARGETS}, {_CAPS}, ranked AS (SELECT book_id, block_id, section_no, word_count, row_number() OVER (PARTITION BY book_id ORDER BY utility DESC, cand_pos) AS rank FROM candidates), "
        "r2 AS (SELECT r.*, coalesce(cap, 600) AS cap, target FROM ranked r LEFT JOIN caps USING (book_id, section_no) JOIN targets USING (book_id)), "
        "fold AS (SELECT book_id, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, [CAST(0 AS BIGINT) FOR i IN range(6)] AS by_, CAST(NULL AS VARCHAR) AS block_id, false AS ok FROM targets UNION ALL "
        "SELECT f.book_id, r.rank, CASE WHEN good THEN f.used + r.word_count ELSE f.used END, CASE WHEN good THEN [CASE WHEN i = r.section_no THEN f.by_[i + 1] + r.word_count ELSE f.by_[i + 1] END FOR i IN range(6)] ELSE f.by_ END, r.block_id, good "
        "FROM fold f JOIN r2 r ON r.book_id = f.book_id AND r.rank = f.rank + 1, LATERAL (SELECT f.used + r.word_count <= r.target AND f.by_[r.section_no + 1] + r.word_count <= r.cap AS good))",
        "SELECT book_id, block_id, rank FROM fold WHERE ok",
        True,
    ),
    "full_selection": _with(_CHOICE, "SELECT book_id, block_id, reading_pos, protected, protected_for, target FROM choice", True),
    "reading_order": _with(f"{_CHOICE}", "SELECT book_id, block_id, reading_pos FROM choice", True),
    "qc_removals": _with(f"{_CHOICE}", "SELECT book_id, block_id FROM (SELECT *, count(*) OVER (PARTITION BY book_id, section_no) AS n FROM choice) WHERE n > 1 AND protected_for = '' AND doc_id % 2 = 0", True),
    "omission_gaps": _with(f"{_CHOICE}, {_GAPS}", "SELECT * FROM gaps", True),
    "turn_gaps": "SELECT book_id, before_id, after_id, pos FROM (SELECT CAST(conv_id AS VARCHAR) AS book_id, 'T' || turn AS before_id, turn AS pos, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt, 'T' || lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS after_id FROM conversations WHERE (turn * 5 + conv_id) % 4 <> 0) WHERE nxt > pos + 1",
    "transition_accept": _with(
        f"{_CHOICE}, {_GAPS}, {_PROPOSALS}",
        "SELECT book_id, pos, before_id, after_id, text, after_id AS blocks, CASE WHEN EXISTS (SELECT 1 FROM reqs r WHERE r.book_id = p2.book_id AND requirement_id = 'R1') THEN 'R1' ELSE '' END AS requirements FROM p2",
        True,
    ),
    "transition_checks": _with(f"{_CHOICE}, {_GAPS}, {_PROPOSALS}", f"SELECT book_id, pos, text FROM p2 WHERE pos % 8 <> 7 AND pos % 4 <> 2 AND pos % 9 <> 1 AND pos % 13 <> 3 AND text <> '' AND {words('text')} <= 5", True),
    "transition_budget": _with(
        f"{_CHOICE}, {_GAPS}, b AS (SELECT book_id, pos, pos * 7 % 23 + 5 AS words, row_number() OVER (PARTITION BY book_id ORDER BY pos) AS k FROM gaps), m AS (SELECT book_id, trunc(sum(word_count)::DOUBLE * 0.02::DOUBLE) AS most FROM choice GROUP BY book_id), "
        "f AS (SELECT book_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS words, CAST(0 AS BIGINT) AS used, false AS ok FROM m UNION ALL "
        "SELECT b.book_id, b.k, b.pos, b.words, CASE WHEN f.used + b.words <= most THEN f.used + b.words ELSE f.used END, f.used + b.words <= most FROM f JOIN b ON b.book_id = f.book_id AND b.k = f.k + 1 JOIN m ON m.book_id = f.book_id)",
        "SELECT book_id, pos, words FROM f WHERE ok",
        True,
    ),
    "section_balance": _with(
        f"{_CHOICE}, r AS (SELECT s.book_id, s.section_no, s.word_count, CAST(coalesce(sum(c.word_count), 0) AS BIGINT) AS retained FROM bsecs s LEFT JOIN choice c USING (book_id, section_no) GROUP BY ALL)",
        "SELECT book_id, section_no, retained, round(retained::DOUBLE / greatest(word_count, 1), 6) AS of_section, round(retained::DOUBLE / greatest(sum(retained) OVER (PARTITION BY book_id), 1), 6) AS of_edition FROM r",
        True,
    ),
    "edition_summary": _with(
        f"{_CHOICE}, w AS (SELECT book_id, CAST(sum(word_count) AS BIGINT) AS source_words FROM bsecs GROUP BY book_id), c AS (SELECT book_id, CAST(sum(word_count) AS BIGINT) AS selected, count(*) AS blocks FROM choice GROUP BY book_id)",
        "SELECT book_id, source_words, target, selected, blocks, round(selected::DOUBLE / greatest(source_words, 1), 6) AS share FROM w JOIN targets USING (book_id) JOIN c USING (book_id)",
        True,
    ),
    "requirement_coverage": _with(
        f"{_CHOICE}, covered AS (SELECT DISTINCT book_id, block_id, reading_pos, unnest(list_concat(covers, terms)) AS requirement_id FROM choice)",
        "SELECT q.book_id, q.requirement_id, q.must, coalesce(string_agg(block_id, ',' ORDER BY reading_pos), '') AS block_ids FROM reqs q LEFT JOIN covered USING (book_id, requirement_id) GROUP BY ALL",
        True,
    ),
    "missing_required": _with(
        f"{_CHOICE}, covered AS (SELECT DISTINCT book_id, unnest(list_concat(covers, terms)) AS requirement_id FROM choice)",
        "SELECT book_id, requirement_id FROM reqs WHERE must AND (book_id, requirement_id) NOT IN (SELECT (book_id, requirement_id) FROM covered)",
        True,
    ),
    "support_repair": _with(_REPAIR, "SELECT * FROM edges"),
    "support_synthetic": _with(_REPAIR, "SELECT * FROM made"),
    "support_promote": _with(
        f"{_REPAIR}, needed AS (SELECT DISTINCT e.book_id, e.source FROM edges e JOIN allreqs q ON q.book_id = e.book_id AND q.requirement_id = e.target AND q.kind = 'major_proposition' AND q.must WHERE e.relation = 'supports')",
        "SELECT a.book_id, requirement_id, CASE WHEN n.source IS NOT NULL AND NOT must THEN 'essential' ELSE importance END AS importance, must OR n.source IS NOT NULL AS must FROM allreqs a LEFT JOIN needed n ON n.book_id = a.book_id AND n.source = a.requirement_id",
    ),
    "map_violations": _with(
        f"{_REQS}, {_RELS}, {_PATH}, d0 AS (SELECT * FROM reqs WHERE pos % 10 < 9 OR book_id LIKE '%7'), d AS (SELECT * FROM d0 UNION ALL SELECT * FROM d0 WHERE book_id = 'src6' AND pos = 3), "
        "ends AS (SELECT book_id, source AS r FROM rels UNION SELECT book_id, target FROM rels), ess AS (SELECT DISTINCT book_id, requirement_id FROM d WHERE kind = 'major_proposition' AND must)",
        "SELECT book_id, 'duplicate requirement' AS violation, requirement_id AS item FROM d GROUP BY ALL HAVING count(*) > 1 "
        "UNION ALL SELECT DISTINCT book_id, 'unknown path requirement', requirement_id FROM path p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.book_id = p.book_id AND d.requirement_id = p.requirement_id) "
        "UNION ALL SELECT book_id, 'dangling relation', r FROM ends e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.book_id = e.book_id AND d.requirement_id = e.r) "
        "UNION ALL SELECT book_id, 'unsupported proposition', requirement_id FROM ess e WHERE NOT EXISTS (SELECT 1 FROM rels r WHERE r.relation = 'supports' AND r.book_id = e.book_id AND r.target = e.requirement_id) "
        "UNION ALL SELECT DISTINCT r.book_id, 'unfit support', r.source FROM rels r JOIN ess e ON e.book_id = r.book_id AND e.requirement_id = r.target JOIN d ON d.book_id = r.book_id AND d.requirement_id = r.source WHERE r.relation = 'supports' AND d.kind NOT IN ('supporting_argument', 'evidence')",
    ),
    "mandatory_order": _with(
        f"{_REQS}, {_PATH}, p AS (SELECT book_id, requirement_id, min(pos) AS p FROM path GROUP BY ALL)",
        "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY p NULLS LAST, pos) AS ord, requirement_id FROM reqs LEFT JOIN p USING (book_id, requirement_id) WHERE must",
    ),
    "section_requirements": _with(
        f"{_REQS}, s AS (SELECT DISTINCT source AS book_id, 'S' || doc_id // 20 AS section_id FROM documents), named AS (SELECT DISTINCT book_id, section_id, requirement_id FROM s JOIN reqs USING (book_id) WHERE list_contains(sections, section_id)), "
        "general AS (SELECT DISTINCT book_id, requirement_id FROM reqs WHERE len(sections) = 0)",
        "SELECT book_id, section_id, requirement_id FROM named UNION SELECT book_id, section_id, requirement_id FROM s JOIN general USING (book_id) "
        "UNION SELECT book_id, section_id, requirement_id FROM s JOIN reqs USING (book_id) WHERE (book_id, section_id) NOT IN (SELECT (book_id, section_id) FROM named) AND book_id NOT IN (SELECT book_id FROM general)",
    ),
    "schema_faults": (
        "WITH d AS (SELECT doc_id, doc_id % 11 <> 3 AS listed FROM documents WHERE doc_id % 23 <> 0) SELECT doc_id, '$' AS path, 'no JSON' AS fault FROM documents WHERE doc_id % 23 = 0 "
        "UNION ALL SELECT doc_id, '$.kind', 'not one of claim, evidence' FROM d WHERE doc_id % 3 = 2 UNION ALL SELECT doc_id, '$.sure', CASE doc_id % 7 WHEN 1 THEN 'missing' ELSE 'not a boolean' END FROM d WHERE doc_id % 7 IN (1, 2) "
        "UNION ALL SELECT doc_id, '$.parts', 'not an array' FROM d WHERE NOT listed UNION ALL SELECT doc_id, '$.parts[0].weight', 'not within 0 and 5' FROM d WHERE listed AND doc_id % 9 > 5 "
        "UNION ALL SELECT doc_id, '$.parts[0].tags[1]', CASE doc_id % 4 WHEN 1 THEN 'not one of a, b' ELSE 'not a string' END FROM d WHERE listed AND doc_id % 4 IN (1, 2) "
        "UNION ALL SELECT doc_id, '$.parts[1]' || t[1], t[2] FROM (SELECT doc_id, unnest([['.extra', 'unknown'], ['.tags', 'missing'], ['.weight', 'not an integer']]) AS t FROM d WHERE listed AND doc_id % 5 = 2) "
        "UNION ALL SELECT doc_id, '$.parts[1]', 'not an object' FROM d WHERE listed AND doc_id % 5 = 3"
    ),
    "overlap_words": (
        f"WITH d AS (SELECT source AS book_id, doc_id AS idx, {words('text')} AS words FROM documents), c AS (SELECT p.book_id, p.idx, p.words, count(*) AS n FROM d p JOIN d s ON s.book_id = p.book_id AND p.idx BETWEEN s.idx AND s.idx + s.idx % 45 GROUP BY ALL) "
        "SELECT book_id, CAST(sum(words * n) AS BIGINT) AS selected_words, CAST(sum(words) AS BIGINT) AS union_words, CAST(sum(words * (n - 1)) AS BIGINT) AS overlap_words FROM c GROUP BY book_id"
    ),
    "long_bins": _with(
        f"d AS (SELECT doc_id, {words('text')} AS words, row_number() OVER (ORDER BY doc_id) AS k FROM documents), bins AS (SELECT doc_id, words, k, CAST(1 AS BIGINT) AS chunk, words AS used FROM d WHERE k = 1 UNION ALL "
        "SELECT d.doc_id, d.words, d.k, CASE WHEN used + d.words > 18000 THEN chunk + 1 ELSE chunk END, CASE WHEN used + d.words > 18000 THEN d.words ELSE used + d.words END FROM bins b JOIN d ON d.k = b.k + 1)",
        "SELECT doc_id, words, chunk FROM bins",
        True,
    ),
    "report_lines": _with(
        f"{_SECS}, t AS (SELECT book_id, count(*) AS n, CAST(coalesce(sum(word_count) FILTER (kind <> 'exclude'), 0) AS BIGINT) AS inc, CAST(coalesce(sum(word_count) FILTER (kind = 'exclude'), 0) AS BIGINT) AS exc, "
        "string_agg('| ' || printf('CH%03d', section_no) || ' | ' || replace(title || CASE WHEN section_no % 13 = 0 THEN ' | more' ELSE '' END, '|', '\\|') || ' | ' || kind || ' | ' || paragraphs || ' | ' || word_count || ' |', chr(10) ORDER BY section_no) AS rows FROM secs JOIN (SELECT section_no, count(*) AS paragraphs FROM paras GROUP BY section_no) USING (section_no) GROUP BY book_id)",
        "SELECT book_id, array_to_string(['# What was read: ' || book_id, '', n || ' sections; ' || inc || ' words to choose from, ' || exc || ' words set aside.', '', '| Section | Heading | Use | Paragraphs | Words |', '|---|---|---|---:|---:|', rows], chr(10)) || chr(10) AS text FROM t",
    ),
    "edition_lines": _with(
        f"{_CHOICE}, {_GAPS}, b AS (SELECT c.book_id, c.section_no, c.reading_pos, {strip('d.text')} AS body, CASE WHEN g.pos % 3 = 0 THEN '*[Leading on] to ' || c.block_id || '*' || chr(10) || chr(10) ELSE '' END AS bridge, "
        "c.reading_pos = min(c.reading_pos) OVER (PARTITION BY c.book_id) AS first FROM choice c JOIN documents d USING (doc_id) LEFT JOIN gaps g ON g.book_id = c.book_id AND g.after_id = c.block_id), "
        "s AS (SELECT book_id, section_no, '## Section ' || section_no || chr(10) || chr(10) || string_agg(CASE WHEN first THEN '' ELSE chr(10) || '* * *' || chr(10) || chr(10) || bridge END || body || chr(10), chr(10) ORDER BY reading_pos) AS t FROM b GROUP BY book_id, section_no), "
        "e AS (SELECT book_id, string_agg(t, chr(10) ORDER BY section_no) AS t FROM s GROUP BY book_id)",
        f"SELECT book_id, {_re(chr(39) + '# ' + chr(39) + ' || book_id || chr(10) || chr(10) || ' + chr(39) + NOTE.replace(chr(39), chr(39) * 2) + chr(39) + ' || chr(10) || chr(10) || t', chr(92) + 's+' + chr(92) + 'z', '')} || chr(10) AS text FROM e",
        True,
    ),
    "qc_additions": _with(
        f"{_CHOICE}, kept AS (SELECT * FROM choice), "
        "asked AS (SELECT c.book_id, c.block_id, c.cand_pos AS pos, c.section_no, c.word_count, c.doc_id % 11 = 0 AS safe, CAST(trunc(coalesce(cap, 600) * 1.15::DOUBLE) AS BIGINT) AS cap, CAST(trunc(target * 1.12::DOUBLE) AS BIGINT) AS most, row_number() OVER (PARTITION BY c.book_id ORDER BY c.cand_pos) AS k "
        "FROM candidates c LEFT JOIN caps USING (book_id, section_no) JOIN targets USING (book_id) WHERE c.doc_id % 4 = 1 AND c.block_id NOT IN (SELECT block_id FROM kept)), "
        "start_ AS (SELECT book_id, list(w ORDER BY i) AS by_ FROM (SELECT t.book_id, i, CAST(coalesce(sum(k.word_count), 0) AS BIGINT) AS w FROM targets t CROSS JOIN (SELECT unnest(range(6)) AS i) LEFT JOIN kept k ON k.book_id = t.book_id AND k.section_no = i GROUP BY ALL) GROUP BY book_id), "
        "f AS (SELECT book_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS block_id, CAST(0 AS BIGINT) AS pos, by_, false AS ok FROM start_ UNION ALL "
        "SELECT f.book_id, a.k, a.block_id, a.pos, CASE WHEN good THEN [CASE WHEN i = a.section_no THEN f.by_[i + 1] + a.word_count ELSE f.by_[i + 1] END FOR i IN range(6)] ELSE f.by_ END, good "
        "FROM f JOIN asked a ON a.book_id = f.book_id AND a.k = f.k + 1, LATERAL (SELECT list_sum(f.by_) + a.word_count <= a.most AND (f.by_[a.section_no + 1] + a.word_count <= a.cap OR a.safe) AS good))",
        "SELECT book_id, block_id, pos FROM f WHERE ok",
        True,
    ),
    "epub_sections": _FILES.format(key="source || '-' || doc_id // 100", least=2),
    "epub_contents": _with(
        _CONTENTS, f"SELECT book_id, printf('CH%03d', row_number() OVER (PARTITION BY book_id ORDER BY part)) AS section_id, title, {kind_by_words('title', 'word_count')} AS kind, paragraphs, word_count FROM s"
    ),
    "docx_sections": _FILES.format(key="source || '-' || doc_id // 100", least=1),
    "text_file_sections": _FILES.format(key="CAST(doc_id AS VARCHAR)", least=2),
    "model_answers": _with(
        f"{_PARAS}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id, section_no ORDER BY idx) AS k FROM paras), "
        "b AS (SELECT book_id, section_no, k, word_count, CAST(1 AS BIGINT) AS chunk, word_count AS used FROM r WHERE k = 1 UNION ALL SELECT r.book_id, r.section_no, r.k, r.word_count, CASE WHEN used + r.word_count > 200 THEN chunk + 1 ELSE chunk END, "
        "CASE WHEN used + r.word_count > 200 THEN r.word_count ELSE used + r.word_count END FROM b JOIN r ON r.section_no = b.section_no AND r.k = b.k + 1)",
        "SELECT book_id, section_no * 1000000 + chunk AS seq, 'development' AS role, 'S' || section_no || ': ' || count(*) || ' paragraphs' AS contribution FROM b GROUP BY book_id, section_no, chunk",
        True,
    ),
    "form_guidance": f"SELECT doc_id, CASE {' '.join(f'WHEN {FORM} = {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in GUIDANCE.items())} END AS guidance FROM documents",
    "proposition_supports": _with(
        _REPAIR,
        "SELECT q.book_id, q.requirement_id, coalesce(string_agg(e.source, ',' ORDER BY e.pos), '') AS supports FROM allreqs q LEFT JOIN edges e ON e.book_id = q.book_id AND e.target = q.requirement_id AND e.relation = 'supports' WHERE q.kind = 'major_proposition' GROUP BY ALL",
    ),
}
ORACLE_SQL["selection_one_book"] = _with(f"documents AS (SELECT * REPLACE ('all' AS source) FROM main.documents), {_CHOICE}", "SELECT block_id, reading_pos, protected, protected_for, target FROM choice", True)
ORACLE_SQL["edition_parts"] = f"SELECT book_id, len(string_split(text, chr(10))) - 1 AS lines, length(text) - len(string_split(text, chr(10))) + 1 AS n_chars FROM ({ORACLE_SQL['edition_lines']})"
ORACLE_SQL["epub_diagnostics"] = (
    f"WITH per AS (SELECT book_id, count(*) AS sections, sum(word_count) AS words FROM ({ORACLE_SQL['epub_sections']}) GROUP BY book_id), m AS (SELECT source || '-' || doc_id // 100 AS book_id, count(*) AS members, CAST(sum(doc_id % 3 * 4) AS BIGINT) AS images_shown FROM documents GROUP BY 1), "
    "r AS (SELECT *, CASE WHEN words < 500 AND images_shown > 5 THEN 'high' WHEN images_shown > members AND words < 5000 THEN 'medium' ELSE 'low' END AS image_risk FROM per JOIN m USING (book_id)) "
    "SELECT book_id, book_id AS title, image_risk <> 'high' AND words >= 500 AS proceed, 'headings' AS contents_from, members, sections, CAST(0 AS BIGINT) AS front_words, CAST(0 AS BIGINT) AS loose_members, images_shown, image_risk, "
    "CASE WHEN image_risk <> 'high' AND words >= 500 THEN 'medium' ELSE 'low' END AS confidence, sections || ' members have no place in the contents' AS notes, CAST(NULL AS VARCHAR) AS error FROM r"
)
