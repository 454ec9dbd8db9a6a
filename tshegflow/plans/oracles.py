"""DuckDB SQL for the queries of the core that SQL can express."""

from __future__ import annotations

from ..functions import letters as L
from . import synthetic


def _re(chars: str) -> str:
    """The inside of a character class with every character that is not ASCII, or not printable, written as an escape."""
    return "".join(c if " " < c < "\x7f" else f"\\x{{{ord(c):04x}}}" for c in chars)


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else _q(v) for v in row) + ")" for row in rows) + f") AS v({names})"


BLOCK, WS = _re(L.BLOCK), _re(L.WHITE_SPACE)
TIB = f"[{BLOCK}]"
NORMAL = "translate(nfc_normalize(text), '​‌‍', '')"
STRIP = lambda e: f"regexp_replace({e}, '^[{WS}]+|[{WS}]+$', '', 'g')"
ONCE = "(SELECT DISTINCT * FROM spell_errors)"

_TYPE = "regexp_replace(text, '[^" + BLOCK + "]', 'O', 'g')"
for _letter, _chars in (("B", L.BASE), ("S", L.SUBJOINED), ("V", L.VOWEL), ("M", L.BLOCK)):
    _TYPE = f"regexp_replace({_TYPE}, '[{_re(_chars)}]', '{_letter}', 'g')"
_SUB = "".join(map(chr, range(0xF90, 0xFBD)))
_BASE = "".join(chr(c - 0x50) for c in range(0xF90, 0xFBD))

SCALARS = {
    "fn_normalize": NORMAL,
    "fn_char_class": f"regexp_matches(text, '^{TIB}')",
    "fn_extract_tibetan": f"regexp_replace(text, '[^{BLOCK}]', '', 'g')",
    "fn_non_tibetan_count": f"CAST(length(regexp_replace(text, '[{BLOCK}{WS}]', '', 'g')) AS BIGINT)",
    "fn_split_simple": f"array_to_string(list_filter(list_transform(string_split(translate(text, '{L.SHAD}{L.DOUBLE_SHAD}{L.NB_TSHEG}', '{L.TSHEG * 3}'), '{L.TSHEG}'), lambda s: {STRIP('s')}), lambda s: s <> ''), '|')",
    "fn_type_string": _TYPE,
    "fn_recognised": f"replace({STRIP('text')}, '§', ' ')",
    "fn_base_form": f"translate(text, '{_SUB}', '{_BASE}')",
}

_STAGE = {syllable: stage for stage, listed in synthetic.STAGES.items() for syllable in listed}
_GOLDEN = _values([(i, *row, _STAGE.get(row[0])) for i, row in enumerate(synthetic.GOLDEN)], "atom, syllable, kind, error_type, component, suffix, post_suffix, stage")
_PARTS = _values([tuple("" if f == "." and i else f for i, f in enumerate(row.split())) for row in synthetic.GOLDEN_PARTS.replace("\n", "|").strip("|").split("|")], "syllable, prefix, superscript, root, subscripts, vowel, suffix, suffix_vowel, post_suffix, unparsed")
# What is said of the faulty syllables of the corpus.
_MESSAGES = _values([
    ("གཀར", "Prefix 'ག' cannot prefix root 'ཀ'"), ("བོདབ", "Syllable has 2 consonants after vowel but only 1 valid suffix position(s)"), ("ལའར", "Consonant ར appears after suffix but is not a valid post-suffix (only ད or ས allowed)"),
    ("ཨེརྡ", "Structural consonant (ྡ) appears after vowel - vowels must come after all consonant clusters"), ("ཨེཨོརོ", "Syllable has 3 vowels - a syllable can only have one vowel (or vowel combination like ོུ)"),
    ("ཕ༹ཀལ", "TSA-PHRU mark (༹) followed by additional consonants - this creates an invalid syllable structure"), ("ཀྰ", 'Wrong "a" character (U+0FB0 instead of U+0F71)'), ("ཀིུ", "Double vowel marks are invalid"), ("ཀཁགངཅཆཇཉ", "Syllable has 8 characters (suspicious)"),
    ("ེབ", "Syllable must have a root letter"), ("ཧཧིབ", "Characters 'ཧ' could not be assigned to any syllable component"), ("པདྨ", "Characters 'ྨ' could not be assigned to any syllable component"), ("བྱབབ", "Characters 'བ' could not be assigned to any syllable component"),
    ("སྐདའི", "Consonant འ appears after suffix but is not a valid post-suffix (only ད or ས allowed)"), ("ཀཔ", "'པ' is not a valid suffix"), ("ངྲ", "Invalid subscript 'ྲ' with root 'ང'"), ("ཀཁགངཅཆ", "Syllable has 6 consonants - likely multiple syllables without tsheg separator"),
], "syllable, message")
# The root letters that each letter may stand over, under or before.
_STACK_ROOTS = _values([
    ("superscript", "ར", "ཀགངཇཉཏདནབམཙཛ"), ("superscript", "ལ", "ཀགངཅཇཏདཔབཧ"), ("superscript", "ས", "ཀགངཉཏདནཔབམཙ"),
    ("subscript", "ྱ", "ཀཁགཔཕབམ"), ("subscript", "ྲ", "ཀཁགཏཐདཔཕབམཤསཧ"), ("subscript", "ླ", "ཀགབཟརས"), ("subscript", "ྭ", "ཀཁགཅཉཏདཙཚཞཟརཤསཧ"),
    ("prefix", "ག", "གངཅཉཏདནབམཙཞཟའཡརལཤསཨ"), ("prefix", "ད", "ཀགངདནཔབམའརལསཨ"), ("prefix", "བ", "ཀགངཅཏདནབམཙཞཟའརལཤསཨ"), ("prefix", "མ", "ཁགངཆཇཉཐདནབམཚཛའརལསཨ"), ("prefix", "འ", "ཁགངཆཇཐདནཕབམཚཛའརལསཨ"),
], "kind, letter, roots")
_ROOTS = "[" + ", ".join(_q(chr(c)) for c in range(0xF40, 0xF6D) if c not in (0xF43, 0xF48, 0xF4D, 0xF52, 0xF57, 0xF5C, 0xF69, 0xF6A, 0xF6B, 0xF6C)) + "]"
_LABELS = "CASE before_suffix WHEN 'ག' THEN 'ག (ga)' WHEN 'ང' THEN 'ང (nga)' WHEN 'ད' THEN 'ད (da)' WHEN 'ན' THEN 'ན (na)' WHEN 'བ' THEN 'བ (ba)' WHEN 'མ' THEN 'མ (ma)' WHEN 'འ' THEN 'འ (achung)' WHEN 'ར' THEN 'ར (ra)' WHEN 'ལ' THEN 'ལ (la)' WHEN 'ས' THEN 'ས (sa)' ELSE 'no suffix' END"
_DELIMITER = "CASE l_partkey % 6 WHEN 3 THEN '" + L.SHAD + " ' WHEN 4 THEN '​" + L.TSHEG + "' WHEN 5 THEN chr(10) ELSE '" + L.TSHEG + "' END"
_FOLLOWS = _values([(p, k, a, i) for i, (p, k, a) in enumerate(L.PARTICLES) if a], "particle, category, follows, ord")
_PREFERRED = _values([(k, s, p) for (k, s), p in L.PREFERRED.items()], "category, suffix, particle")
_KINDS = _values([(p, k) for p, k, _ in L.PARTICLES], "particle, category")


def _synthetic(page: bool = False, lexicon: bool = False) -> str:
    """The corpus and its faults; with ``lexicon``, words that it lacks are faults too."""
    golden = f"SELECT *, false AS known FROM {_GOLDEN}"
    if lexicon:
        lacking = "kind = 'syllable' AND error_type IS NULL AND NOT known AND (SELECT count(*) FROM inventory) > 0"
        golden = f"""SELECT * REPLACE (CASE WHEN {lacking} THEN 'unknown_word' ELSE error_type END AS error_type, CASE WHEN {lacking} THEN NULL ELSE suffix END AS suffix, CASE WHEN {lacking} THEN NULL ELSE post_suffix END AS post_suffix, CASE WHEN {lacking} THEN 'component' ELSE stage END AS stage)
      FROM (SELECT *, syllable IN (SELECT syllable FROM inventory) AS known FROM {_GOLDEN})"""
    by = "l_orderkey" + (", 1 + l_linenumber // 3" if page else "")
    return f"""
  golden AS ({golden}),
  follows AS (SELECT * FROM {_FOLLOWS}), preferred AS (SELECT * FROM {_PREFERRED}), kinds AS (SELECT * FROM {_KINDS}),
  seq AS (
    SELECT l_orderkey AS doc_id, g.*, CASE WHEN g.error_type = 'encoding_error' THEN 'critical' WHEN g.error_type = 'unknown_word' THEN 'warning' WHEN g.error_type IS NOT NULL THEN 'error' END AS severity, g.syllable || {_DELIMITER} AS tok,
      row_number() OVER (PARTITION BY {by} ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, 1 + l_linenumber // 3 AS page_number
    FROM lineitem JOIN golden g ON g.atom = (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 50
  ),
  tokens AS (
    SELECT *, CAST(coalesce(sum(length(tok)) OVER w, 0) AS INTEGER) AS position, lag(suffix) OVER v AS before_suffix, lag(post_suffix) OVER v AS before_post
    FROM seq WINDOW w AS (PARTITION BY doc_id{', page_number' if page else ''} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), v AS (PARTITION BY doc_id{', page_number' if page else ''} ORDER BY n)
  ),
  wrong AS (
    SELECT t.*, f.category FROM tokens t JOIN follows f ON f.particle = t.syllable
    WHERE t.error_type IS NULL AND t.before_suffix IS NOT NULL AND NOT contains(f.follows, t.before_suffix) AND NOT coalesce(contains(f.follows, t.before_post), false)
  ),
  faults AS (
    SELECT doc_id, position, syllable AS word, error_type, severity, component FROM tokens WHERE error_type IS NOT NULL
    UNION ALL SELECT doc_id, position, syllable, 'wrong_particle_form', 'error', 'particle' FROM wrong
  ),
  docs AS (SELECT doc_id, CAST(sum(length(tok)) AS INTEGER) AS text_length, sum(length(regexp_replace(tok, '[{BLOCK}{WS}]', '', 'g'))) AS skipped FROM seq GROUP BY doc_id),
  errors AS (SELECT * FROM faults UNION ALL SELECT doc_id, 0, '', 'non_tibetan_skipped', 'info', NULL FROM docs WHERE skipped > 0)
"""


def _synth(select: str) -> str:
    return f"WITH {_synthetic()} {select}"


def _synth_lexicon(select: str) -> str:
    return f"WITH inventory AS ({_INVENTORY}), {_synthetic(lexicon=True).lstrip()} {select}"


_GROUPED = "SELECT syllable, error_type, severity, component, count(*) AS n FROM tokens WHERE {} GROUP BY ALL"

_INVENTORY = f"SELECT DISTINCT s AS syllable FROM (SELECT unnest(list_filter(list_transform(string_split(nfc_normalize(word_normalized), '{L.TSHEG}'), lambda s: {STRIP('s')}), lambda s: s <> '')) AS s FROM word)"
_CLEAN = lambda e: f"nfc_normalize({STRIP(e)})"
_LEGACY = "legacy AS (SELECT word, unnest([first_seen_in, 'ri_bo_list', lower(dialect)]) AS source_key FROM word)"
_SOLID = f"regexp_replace(coalesce(text, ''), '[{WS}]', '', 'g')"
_PHANTOMS = [f"CAST((length(t) - length(replace(t, '{p}', ''))) // {len(p)} AS BIGINT)" for p in L.PHANTOMS]
_WHOLE = "whole AS (SELECT job_id, string_agg(coalesce(text, ''), '' ORDER BY page_number, page_id) AS t FROM page_content GROUP BY job_id)"
_PUA = f"pua AS (SELECT job_id, CAST(sum(length(regexp_replace({_SOLID}, '[^\\x{{e000}}-\\x{{f8ff}}]', '', 'g'))) AS BIGINT) AS private_use, CAST(sum(length({_SOLID})) AS BIGINT) AS characters FROM page_content GROUP BY job_id)"
_SCAN = "scan AS (SELECT job_id, count(*) AS pages_seen, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS characters FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY page_number, page_id) AS r FROM page_content) WHERE r <= 3 GROUP BY job_id)"
_MARKED = "marked AS (SELECT DISTINCT job_id, page_number, word FROM spell_errors WHERE word <> '' AND page_number IS NOT NULL)"
_ZERO_WIDTH = "'​‌‍'"
# the sizes of the NFC of every beginning of a text; a text in NFC needs none of them
_MAPPED = "(SELECT *, nfc_normalize(text) AS nfc, CASE WHEN text <> nfc_normalize(text) THEN [length(nfc_normalize(substr(text, 1, i))) FOR i IN range(1, length(text) + 1)] END AS sizes FROM check_requests)"
_MAP = f"CASE WHEN text = nfc THEN [i FOR i IN range(0, length(text)) IF NOT contains({_ZERO_WIDTH}, substr(text, i + 1, 1))] ELSE [len(list_filter(sizes, lambda z: z < k)) FOR k IN range(1, length(nfc) + 1) IF NOT contains({_ZERO_WIDTH}, substr(nfc, k, 1))] END"
_CHANGELOG = """
WITH rows_ AS (SELECT DISTINCT l_orderkey AS file_id, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS line_no, l_partkey % 8 AS k, l_partkey AS p, l_suppkey AS s FROM lineitem),
  a AS (SELECT *, sum((k IN (0, 5))::INT) OVER w AS v, sum((k IN (0, 1, 2, 5, 6))::INT) OVER w AS c,
      last_value(CASE k WHEN 0 THEN '1.' || s || '.0' WHEN 5 THEN 'Unreleased' END IGNORE NULLS) OVER w AS version, last_value(CASE k WHEN 0 THEN '2024-01-01' WHEN 5 THEN '' END IGNORE NULLS) OVER w AS released,
      last_value(CASE k WHEN 0 THEN '' WHEN 5 THEN '' WHEN 6 THEN '' WHEN 1 THEN 'Added' WHEN 2 THEN 'Fixed' END IGNORE NULLS) OVER w AS category
    FROM rows_ WINDOW w AS (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  b AS (SELECT *, sum((k IN (3, 7))::INT) OVER (PARTITION BY file_id, c ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS item_no FROM a)
SELECT file_id, version, nullif(released, '') AS released, category, CAST(item_no AS INTEGER) AS item_no,
  string_agg(CASE k WHEN 3 THEN 'item ' || p WHEN 7 THEN 'entry ' || p ELSE 'more ' || p END, ' ' ORDER BY line_no) AS item
FROM b WHERE v > 0 AND category <> '' AND item_no > 0 AND k IN (3, 4, 7) GROUP BY file_id, version, released, category, c, item_no
"""

_SUGGESTION = "coalesce((SELECT p.particle FROM preferred p WHERE p.category = w.category AND p.suffix = w.before_suffix), (SELECT min_by(f.particle, f.ord) FROM follows f WHERE f.category = w.category AND contains(f.follows, w.before_suffix)))"
_LOG = """SELECT doc_id, text_length, count(e.error_type) AS error_count, count(e.error_type) FILTER (e.severity NOT IN ('warning', 'info')) AS structural_errors, count(*) FILTER (e.error_type = 'unknown_word') AS unknown_words,
      count(*) FILTER (e.hit) AS corpus_hits, coalesce(bool_or(e.hit IS NOT NULL), false) AS dict_active
    FROM docs LEFT JOIN (SELECT doc_id, error_type, severity, CASE WHEN stage = 'component' AND (SELECT count(*) FROM inventory) > 0 THEN known END AS hit FROM tokens WHERE error_type IS NOT NULL
      UNION ALL SELECT doc_id, error_type, severity, NULL FROM errors WHERE error_type IN ('wrong_particle_form', 'non_tibetan_skipped')) e USING (doc_id) GROUP BY ALL"""
_LOADED = f"""keyed AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'reader_' || source_key ELSE source_key END AS source_key FROM lexicon_source), read AS (SELECT DISTINCT {_CLEAN('word')} AS word, k.source_key, k.id FROM spell_errors JOIN keyed k ON k.id = 1 + page_number % 6),
      kept AS (SELECT * FROM read WHERE word <> '' AND regexp_matches(word, '{TIB}')), incoming AS (SELECT word, min_by(source_key, id) AS first_seen_in FROM kept GROUP BY word HAVING count(*) >= 2),
      links AS (SELECT word, source_key FROM kept WHERE word IN (SELECT word FROM incoming))"""
_CENTERS = "SELECT DISTINCT page_id, line_id, x, y, width, height, CAST(x + width // 2 AS INTEGER) AS x_center, CAST(y + height // 2 AS INTEGER) AS y_center FROM ocr_lines"
_SAME_LINE = "abs(s.total / s.n - b.y) <= 20"
_LINE_GROUPS = f"""centers AS ({_CENTERS}), b AS (SELECT page_id, x_center AS x, y_center AS y, row_number() OVER (PARTITION BY page_id ORDER BY line_id) AS i FROM centers),
      s AS (SELECT page_id, i, x, y, 1 AS line, CAST(y AS DOUBLE) AS total, 1 AS n FROM b WHERE i = 1
        UNION ALL SELECT b.page_id, b.i, b.x, b.y, CASE WHEN {_SAME_LINE} THEN s.line ELSE s.line + 1 END, CASE WHEN {_SAME_LINE} THEN s.total + b.y ELSE b.y END, CASE WHEN {_SAME_LINE} THEN s.n + 1 ELSE 1 END FROM s JOIN b ON b.page_id = s.page_id AND b.i = s.i + 1),
      lines AS (SELECT page_id, CAST(max(line) OVER (PARTITION BY page_id) - line + 1 AS INTEGER) AS line_no, CAST(row_number() OVER (PARTITION BY page_id, line ORDER BY x, i) AS INTEGER) AS place, x, y FROM s)"""
_SEEDS = _values([(w,) for w in L.SEED_WORDS], "word")
_WORDS = "SELECT page_id, job_id, page_number, text_layer, unnest(words) AS w, generate_subscripts(words, 1) AS word_no FROM page_content"

ORACLES = {
    "fn_position_map": f"SELECT request_id, array_to_string({_MAP}, ',') AS value FROM {_MAPPED}",
    "tok_positions": f"""SELECT request_id, CAST(unnest(range(0, len(tokens))) AS INTEGER) AS token_no, unnest(tokens) AS syllable, CAST(unnest([places[k] FOR k IN starts]) AS INTEGER) AS position FROM (
      SELECT request_id, places, regexp_extract_all(normal, '[^{_re(L.TOKEN_DELIMITERS)}]+') AS tokens,
        [k FOR k IN range(1, length(normal) + 1) IF NOT regexp_matches(substr(normal, k, 1), '[{_re(L.TOKEN_DELIMITERS)}]') AND (k = 1 OR regexp_matches(substr(normal, k - 1, 1), '[{_re(L.TOKEN_DELIMITERS)}]'))] AS starts
      FROM (SELECT request_id, {_MAP} AS places, {NORMAL} AS normal FROM {_MAPPED} WHERE text IS NOT NULL))""",
    "fn_format_error_type": "SELECT error_type, array_to_string(list_transform(string_split(error_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM (SELECT DISTINCT error_type FROM spell_errors WHERE error_type IS NOT NULL)",
    "fn_severity_map": f"SELECT error_type, coalesce(severity, 'warning') AS severity, n FROM (SELECT error_type, count(*) AS n FROM spell_errors WHERE error_type IS NOT NULL GROUP BY 1) LEFT JOIN (SELECT * FROM {_values(list(L.SEVERITIES.items()), 'error_type, severity')}) USING (error_type)",
    "fn_kwic": f"""SELECT id, substr(text, greatest(position - 20, 0) + 1, position - greatest(position - 20, 0)) || '[' || substr(text, position + 1, least(position + length(word), length(text)) - position) || ']'
      || substr(text, least(position + length(word), length(text)) + 1, least(position + length(word) + 20, length(text)) - least(position + length(word), length(text))) AS context
      FROM {ONCE} JOIN page_content USING (job_id, page_number) WHERE word <> '' AND position >= 0 AND position < length(text)""",
    "fn_token_kind": f"""SELECT syllable, CASE WHEN NOT regexp_matches(syllable, '{TIB}') THEN 'other' WHEN regexp_full_match(syllable, '[{_re(L.NUMERAL)}]+') THEN 'numeral'
      WHEN regexp_full_match(syllable, '[{_re(L.NOT_SPELLABLE)}]+') THEN 'punctuation' WHEN syllable IN ({", ".join(map(_q, L.EXCEPTIONS))}) THEN 'exception' ELSE 'syllable' END AS kind, count(*) AS n
      FROM (SELECT unnest(regexp_extract_all({NORMAL}, '[^{_re(L.TOKEN_DELIMITERS)}]+')) AS syllable FROM check_requests) GROUP BY ALL""",
    "rule_stack_pairs": f"SELECT kind, letter, root, contains(roots, root) AS valid FROM (SELECT *, unnest({_ROOTS}) AS root FROM {_STACK_ROOTS})",
    "err_messages": _synth(f"SELECT DISTINCT t.syllable, error_type, message FROM tokens t JOIN {_MESSAGES} USING (syllable)"),
    "src_text_length_gate": "SELECT request_id, length(text) AS n, coalesce(length(text) BETWEEN 1 AND 100000, false) AS accepted FROM check_requests",
    "src_upload_gate": "SELECT id, CASE WHEN NOT coalesce(lower(file_name) LIKE '%.pdf', false) THEN 400 WHEN coalesce(file_size, 0) <= 0 THEN 400 WHEN file_size > 52428800 THEN 413 WHEN page_count IS NULL THEN 422 ELSE 200 END AS status_code FROM jobs",
    "src_sync_route": "SELECT id, CASE WHEN page_count <= 15 THEN 'sync' ELSE 'async' END AS mode FROM jobs",
    "check_text_errors": _synth("SELECT * FROM errors"),
    "agg_check_log": _synth_lexicon(_LOG),
    "log_lines": _synth_lexicon(
        f"""SELECT doc_id, 'spellcheck_result {{"source": "text", "text_length": ' || text_length || ', "error_count": ' || error_count || ', "phase1_errors": ' || structural_errors || ', "unknown_words": ' || unknown_words
        || ', "corpus_hits": ' || corpus_hits || ', "dict_active": ' || dict_active || '}}' AS line FROM ({_LOG})"""
    ),
    "particle_messages": _synth(
        f"""SELECT syllable AS word, 'Wrong ' || category || ' particle ' || chr(39) || syllable || chr(39) || ' after a word ending in ' || {_LABELS} || coalesce(' (expected ' || {_SUGGESTION} || ')', '') AS message, count(*) AS n FROM wrong w GROUP BY ALL"""
    ),
    "particle_errors": _synth("SELECT doc_id, position, syllable AS word FROM wrong"),
    "particle_suggestions": _synth(f"SELECT syllable AS word, category, {_SUGGESTION} AS suggestion, count(*) AS n FROM wrong w GROUP BY ALL"),
    "info_rows": f"SELECT request_id, CAST(length(regexp_replace(text, '[{BLOCK}{WS}]', '', 'g')) AS BIGINT) AS skipped FROM check_requests WHERE length(regexp_replace(text, '[{BLOCK}{WS}]', '', 'g')) > 0",
    "tok_kind_counts": _synth("SELECT kind, count(*) AS n FROM tokens GROUP BY kind"),
    "parse_components": _synth(f"SELECT DISTINCT p.* FROM tokens JOIN {_PARTS.replace(' AS v(', ' AS p(')} USING (syllable)"),
    "check_syllable_outcome": _synth("SELECT DISTINCT syllable, kind, error_type, severity, component FROM tokens"),
    "err_pattern": _synth(_GROUPED.format("stage = 'pattern'")),
    "err_completeness": _synth(_GROUPED.format("stage = 'completeness'")),
    "err_component": _synth(_GROUPED.format("stage = 'component'")),
    "dict_lookup_tristate": f"""WITH inventory AS ({_INVENTORY}), golden AS (SELECT *, syllable IN (SELECT syllable FROM inventory) AS known, kind = 'syllable' AND error_type IS NULL AND NOT syllable IN (SELECT syllable FROM inventory) AS lacking FROM {_GOLDEN} JOIN (SELECT DISTINCT (l_partkey * 7 + l_suppkey * 3 + l_linenumber) % 50 AS atom FROM lineitem) USING (atom))
      SELECT 'loaded' AS lexicon, syllable, CASE WHEN lacking THEN 'unknown_word' ELSE error_type END AS error_type, CASE WHEN lacking OR stage = 'component' THEN known END AS corpus_hit FROM golden UNION ALL SELECT 'empty', syllable, error_type, NULL FROM golden""",
    "corpus_load_words": f"WITH {_LOADED} SELECT word, word_normalized, first_seen_in FROM word UNION ALL SELECT word, word, first_seen_in FROM incoming WHERE word NOT IN (SELECT word FROM word)",
    "corpus_load_sources": f"WITH {_LOADED} SELECT source_key, display_name FROM lexicon_source UNION ALL SELECT DISTINCT source_key, source_key FROM links WHERE source_key NOT IN (SELECT source_key FROM lexicon_source)",
    "corpus_load_links": f"WITH {_LOADED} SELECT word, first_seen_in AS source_key FROM word WHERE first_seen_in IS NOT NULL UNION SELECT word, source_key FROM links",
    "corpus_replace_words": f"WITH {_LOADED} SELECT word, word AS word_normalized, first_seen_in FROM incoming",
    "corpus_replace_links": f"WITH {_LOADED} SELECT word, source_key FROM links",
    "seed_upsert": f"SELECT word, word_normalized, first_seen_in FROM word UNION ALL SELECT word, word, 'seed_corpus' FROM {_SEEDS} WHERE word NOT IN (SELECT word FROM word)",
    "page_words": f"SELECT page_id, CAST(word_no AS INTEGER) AS word_no, w.text AS word, w.x0 AS x0, w.y0 AS y0, w.x1 AS x1, w.y1 AS y1 FROM ({_WORDS}) WHERE regexp_matches(w.text, '[^{WS}]')",
    "pdf_digital_boxes": f"""WITH {_MARKED} SELECT page_id, CAST(word_no AS INTEGER) AS word_no, m.word, round(w.x0 + (w.x1 - w.x0) * (strpos(w.text, m.word) - 1) / length(w.text), 4) AS x0, w.y0 AS y0, round(w.x0 + (w.x1 - w.x0) * (strpos(w.text, m.word) - 1 + length(m.word)) / length(w.text), 4) AS x1, w.y1 AS y1
      FROM ({_WORDS}) JOIN marked m USING (job_id, page_number) WHERE text_layer <> 'ocr' AND regexp_matches(w.text, '[^{WS}]') AND contains(w.text, m.word)""",
    "page_text": "SELECT page_id, string_agg(text, chr(10) ORDER BY line_no, encode(text)) AS text FROM (SELECT DISTINCT page_id, line_no, text FROM ocr_lines WHERE text <> '') GROUP BY page_id",
    "errors_filled": f"SELECT id, coalesce(word, '') AS word, page_number AS page, coalesce(error_type, 'unknown') AS error_type, coalesce(severity, 'error') AS severity, message, component, corpus_hit FROM {ONCE}",
    "console_report": f"""WITH c AS (SELECT job_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'error') AS e, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (severity = 'info') AS i FROM {ONCE} GROUP BY job_id)
      SELECT job_id, 'Total errors found: ' || (c + e + w + i) || CASE WHEN c > 0 THEN chr(10) || '  CRITICAL: ' || c ELSE '' END || CASE WHEN e > 0 THEN chr(10) || '  ERROR: ' || e ELSE '' END || CASE WHEN i > 0 THEN chr(10) || '  INFO: ' || i ELSE '' END AS report, CASE WHEN c + e + w + i = 0 THEN 0 ELSE 1 END AS exit_code FROM c""",
    "changelog_unreleased": "SELECT DISTINCT l_orderkey AS file_id, 'Unreleased' AS version, l_linenumber * 10000000000 + l_partkey * 100000 + l_suppkey AS at FROM lineitem WHERE l_partkey % 8 = 5",
    "ocr_centers": _CENTERS,
    "ocr_line_groups": f"WITH RECURSIVE {_LINE_GROUPS} SELECT * FROM lines",
    "ocr_merged_lines": f"""WITH RECURSIVE {_LINE_GROUPS}, first AS (SELECT * FROM centers QUALIFY row_number() OVER (PARTITION BY page_id, x_center, y_center ORDER BY line_id) = 1)
      SELECT l.page_id, l.line_no, min(f.x) AS x, min(f.y) AS y, max(f.x + f.width) - min(f.x) AS width, max(f.y + f.height) - min(f.y) AS height FROM lines l JOIN first f ON f.page_id = l.page_id AND f.x_center = l.x AND f.y_center = l.y GROUP BY ALL""",
    "ocr_line_threshold": """WITH once AS (SELECT DISTINCT page_id, line_id, x, y, width, height FROM ocr_lines), frame AS (SELECT page_id, min(x) AS l, CAST(((max(x + width) - min(x)) // 20) // 2 AS INTEGER) AS step FROM once GROUP BY page_id),
      starts AS (SELECT page_id, unnest([l + step * i FOR i IN range(1, step + 1)]) AS s FROM frame), met AS (SELECT page_id, s, y + height // 2 AS c FROM starts JOIN once USING (page_id) WHERE x < s + 20 AND x + width > s),
      each AS (SELECT page_id, s, count(*) AS n, median(c) AS m FROM met GROUP BY ALL), best AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC, s) = 1)
      SELECT page_id, CAST(s AS INTEGER) AS slice_start, coalesce(n, 0) AS boxes, CAST(coalesce(floor(m / n), 0) AS DOUBLE) AS threshold FROM frame LEFT JOIN best USING (page_id)""",
    "ocr_curved_share": "SELECT page_id, count(*) AS lines, round(avg((width % 5 = 0)::INT), 6) AS share FROM ocr_lines GROUP BY page_id",
    "ocr_paired": """WITH l AS (SELECT page_id, text AS left_text, row_number() OVER (PARTITION BY page_id ORDER BY line_no, encode(text)) AS place FROM (SELECT DISTINCT page_id, line_no, text FROM ocr_lines)),
      r AS (SELECT page_id, unnest(string_split(text, chr(10))) AS right_text, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM page_content WHERE text IS NOT NULL) SELECT page_id, CAST(place AS INTEGER) AS place, left_text AS "left", right_text AS "right" FROM l JOIN r USING (page_id, place)""",
    "dict_inventory": _INVENTORY,
    "corpus_stats": f"SELECT count(word_normalized) > 0 AS available, count(word_normalized) AS word_count, (SELECT count(*) FROM ({_INVENTORY})) AS syllable_count FROM word",
    "corpus_cross_reference": f"""WITH each AS (SELECT unnest([word, word_normalized]) AS word, first_seen_in AS source_key FROM word),
      clean AS (SELECT DISTINCT {_CLEAN('word')} AS word, source_key FROM each), kept AS (SELECT word, source_key, id FROM clean JOIN lexicon_source USING (source_key) WHERE word <> '' AND regexp_matches(word, '{TIB}'))
      SELECT word, count(*) AS source_count, string_agg(source_key, ',' ORDER BY id) AS sources, min_by(source_key, id) AS first_seen_in FROM kept GROUP BY word HAVING count(*) >= 2""",
    "corpus_upsert": f"""WITH clean AS (SELECT DISTINCT {_CLEAN('word')} AS word FROM spell_errors) SELECT word, word AS word_normalized FROM clean WHERE word <> '' AND regexp_matches(word, '{TIB}')
      AND word NOT IN (SELECT word FROM word WHERE word IS NOT NULL UNION SELECT word_normalized FROM word WHERE word_normalized IS NOT NULL)""",
    "migrate_sources": f"WITH {_LEGACY} SELECT DISTINCT source_key, source_key AS display_name FROM legacy WHERE source_key IS NOT NULL",
    "migrate_word_source": f"WITH {_LEGACY} SELECT DISTINCT w.id AS word_id, s.id AS source_id FROM legacy JOIN word w USING (word) JOIN lexicon_source s USING (source_key)",
    "pdf_pua_ratio": f"WITH {_PUA} SELECT job_id, private_use, characters, characters > 0 AND private_use * 100 > characters * 5 AS broken FROM pua",
    "pdf_phantom_counts": f"WITH {_WHOLE} SELECT job_id, {_PHANTOMS[0]} AS phantom_1, {_PHANTOMS[1]} AS phantom_2 FROM whole",
    "pdf_is_scanned": f"WITH {_SCAN} SELECT job_id, pages_seen, characters, characters < 10 * greatest(pages_seen, 1) AS is_scanned FROM scan",
    "pdf_route": f"""WITH {_WHOLE}, {_PUA}, {_SCAN}, reasons AS (SELECT job_id, CASE WHEN scan.characters < 10 * greatest(pages_seen, 1) THEN 'scanned' WHEN pua.characters > 0 AND private_use * 100 > pua.characters * 5 THEN 'private_use'
      WHEN greatest({_PHANTOMS[0]}, {_PHANTOMS[1]}) >= 3 THEN 'phantoms' ELSE 'text' END AS reason FROM whole JOIN pua USING (job_id) JOIN scan USING (job_id)) SELECT job_id, CASE reason WHEN 'text' THEN 'digital' ELSE 'ocr' END AS route, reason FROM reasons""",
    "pdf_route_fonts": f"""WITH {_WHOLE}, {_PUA}, {_SCAN}, reasons AS (SELECT job_id, CASE WHEN scan.characters < 10 * greatest(pages_seen, 1) THEN 'scanned' WHEN job_id IN (SELECT id FROM jobs WHERE file_size % 7 = 0) THEN 'font' WHEN pua.characters > 0 AND private_use * 100 > pua.characters * 5 THEN 'private_use'
      WHEN greatest({_PHANTOMS[0]}, {_PHANTOMS[1]}) >= 3 THEN 'phantoms' ELSE 'text' END AS reason FROM whole JOIN pua USING (job_id) JOIN scan USING (job_id)) SELECT job_id, CASE reason WHEN 'text' THEN 'digital' ELSE 'ocr' END AS route, reason FROM reasons""",
    "pdf_page_errors": f"SELECT job_id, page_number, count(*) AS error_count, count(*) FILTER (coalesce(component, '') = '') AS without_component, coalesce(string_agg(CASE WHEN word <> '' THEN word END, ' ' ORDER BY encode(word)), '') AS words FROM {ONCE} WHERE page_number IS NOT NULL GROUP BY ALL",
    "pdf_scanned_highlights": f"""WITH {_MARKED}, lines AS (SELECT DISTINCT page_id, line_no, text, x, y, width, height FROM ocr_lines),
      pages AS (SELECT page_id, job_id, page_number, width AS page_width, height AS page_height FROM page_content WHERE text_layer = 'ocr'),
      hit AS (SELECT DISTINCT l.page_id, line_no, x, y, width, height, page_width, page_height FROM (SELECT *, unnest(string_split(text, '{L.TSHEG}')) AS syllable FROM lines) l JOIN pages USING (page_id) JOIN marked m ON m.job_id = pages.job_id AND m.page_number = pages.page_number AND m.word = l.syllable),
      boxes AS (SELECT page_id, line_no, greatest(0.0::DOUBLE, least(x * 72 / 300, page_width)) AS x0, greatest(0.0::DOUBLE, least(y * 72 / 300, page_height)) AS y0, greatest(0.0::DOUBLE, least((x + width) * 72 / 300, page_width)) AS x1, greatest(0.0::DOUBLE, least((y + height) * 72 / 300, page_height)) AS y1 FROM hit)
      SELECT * FROM boxes WHERE x1 > x0 AND y1 > y0""",
    "pdf_digital_matches": f"WITH {_MARKED} SELECT page_id, word, CAST((length(text) - length(replace(text, word, ''))) // length(word) AS BIGINT) AS matches FROM page_content JOIN marked USING (job_id, page_number) WHERE text_layer <> 'ocr' AND contains(text, word)",
    "doc_runs": f"""WITH {_MARKED}, lines AS (SELECT page_id, job_id, page_number, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM page_content),
      each AS (SELECT page_id, job_id, page_number, line_no, unnest(regexp_extract_all(line, '{L.TSHEG}| |[^{L.TSHEG} ]+')) AS run, generate_subscripts(regexp_extract_all(line, '{L.TSHEG}| |[^{L.TSHEG} ]+'), 1) AS run_no FROM lines)
      SELECT page_id, CAST(line_no AS INTEGER) AS line_no, CAST(run_no AS INTEGER) AS run_no, run, m.word IS NOT NULL AS is_error FROM each e LEFT JOIN marked m ON m.job_id = e.job_id AND m.page_number = e.page_number AND m.word = e.run""",
    "doc_page_blocks": f"""SELECT page_id, 'Page ' || page_number AS heading, NOT coalesce(regexp_matches(text, '[^{WS}]'), false) AS is_blank, CASE WHEN coalesce(regexp_matches(text, '[^{WS}]'), false) THEN CAST(len(string_split(text, chr(10))) AS INTEGER) ELSE 0 END AS lines,
      page_number < max(page_number) OVER (PARTITION BY job_id) AS page_break FROM page_content""",
    "agg_severity": f"SELECT job_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'error') AS error, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM {ONCE} GROUP BY job_id",
    "ui_severity_split": f"SELECT job_id, count(*) FILTER (severity IN ('error', 'critical')) AS structural, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos FROM {ONCE} WHERE position >= 0 GROUP BY job_id",
    "ui_spans": f"""WITH cells AS (SELECT job_id, page_number, id, created_at, unnest(range(position, position + length(word))) AS spot FROM {ONCE} WHERE word <> '' AND page_number IS NOT NULL AND position >= 0 AND severity <> 'info'),
      painted AS (SELECT job_id, page_number, spot, arg_max(id, row(created_at, id)) AS id FROM cells GROUP BY ALL),
      islands AS (SELECT *, spot - row_number() OVER (PARTITION BY job_id, page_number, id ORDER BY spot) AS island FROM painted)
      SELECT job_id, page_number, id, CAST(min(spot) AS INTEGER) AS start_pos, CAST(max(spot) + 1 AS INTEGER) AS end_pos FROM islands GROUP BY job_id, page_number, id, island""",
    "freq_corpus": f"SELECT word, count(*) AS n FROM {ONCE} WHERE word <> '' GROUP BY word HAVING count(*) >= 3",
    "top_unknown_words": f"SELECT word, count(*) AS n FROM {ONCE} WHERE word <> '' AND error_type = 'unknown_word' GROUP BY word ORDER BY n DESC, encode(word) LIMIT 100",
    "changelog_parse": _CHANGELOG,
    "job_status": "SELECT file_name, id, status, progress, CASE WHEN status = 'completed' THEN error_count END AS error_count FROM (SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY updated_at DESC, id DESC) AS r FROM jobs) WHERE r = 1",
    "ocr_box_filter": "SELECT line_id, o.page_id, o.width, o.height FROM ocr_lines o JOIN page_content p USING (page_id) WHERE o.width > 0.01 * p.width * 300 / 72 AND o.height > 10",
    "ocr_rotation_angle": """WITH a AS (SELECT page_id, ((x * 7 + y) % 91) * 1.0::DOUBLE AS angle FROM ocr_lines), s AS (SELECT page_id, count(*) FILTER (abs(angle) <> 0 AND angle < 5) AS lows, count(*) FILTER (abs(angle) <> 90 AND angle > 85) AS highs,
      avg(angle) FILTER (abs(angle) <> 0 AND angle < 5) AS low, avg(angle) FILTER (abs(angle) <> 90 AND angle > 85) AS high FROM a GROUP BY page_id) SELECT page_id, round(CASE WHEN lows > highs AND lows > 0 THEN low WHEN highs > 0 THEN high - 90 ELSE 0 END, 6) AS angle FROM s""",
}


def _parity(select: str) -> str:
    whole = f"SELECT * FROM (WITH {_synthetic()} SELECT * FROM faults)"
    paged = f"SELECT * FROM (WITH {_synthetic(True)} SELECT * FROM faults)"
    return f"WITH whole AS ({whole}), paged AS ({paged}) {select}"


def oracle_sql() -> dict[str, str]:
    out = ORACLES | {name: f"SELECT request_id, {value} AS value FROM check_requests" for name, value in SCALARS.items()}
    out["parity_type_diff"] = _parity("SELECT DISTINCT doc_id, error_type FROM whole WHERE (doc_id, error_type) NOT IN (SELECT (doc_id, error_type) FROM paged)")
    out["parity_count_diff"] = _parity(
        "SELECT doc_id, coalesce(l, 0) AS left_errors, coalesce(r, 0) AS right_errors, abs(coalesce(l, 0) - coalesce(r, 0)) AS difference, abs(coalesce(l, 0) - coalesce(r, 0)) <= 0 AS within "
        "FROM (SELECT doc_id, count(*) AS l FROM paged GROUP BY 1) FULL JOIN (SELECT doc_id, count(*) AS r FROM whole GROUP BY 1) USING (doc_id)"
    )
    return out
