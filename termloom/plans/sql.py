"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from termloom.functions import phonetics, text

_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in (phonetics.GROUPS | phonetics.SINGLES).items()) + "}"
_GROUPS = "(" + "|".join(phonetics.GROUPS) + "|[a-z])"
_WORD = text.WORD.replace("'", "''")
_CONTENT = text.CONTENT_WORD.replace("'", "''")
_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def winkler(a: str, b: str) -> str:
    """Jaro-Winkler from the Jaro similarity, in plain steps: DuckDB's own function rounds once for the product and the sum."""
    same = " ".join(f"WHEN length({a}) >= {n} AND length({b}) >= {n} AND substr({a}, 1, {n}) = substr({b}, 1, {n}) THEN {n}" for n in (4, 3, 2, 1))
    jaro = f"jaro_similarity({a}, {b})"
    return f"(CASE WHEN {jaro} > 0.7::DOUBLE THEN {jaro} + (CASE {same} ELSE 0 END)::DOUBLE * 0.1::DOUBLE * (1.0::DOUBLE - {jaro}) ELSE {jaro} END)"


def strict_ctes(source: str, column: str, name: str) -> str:
    """CTEs that add plain, strict, loose and fuzzy of ``column`` to the rows of ``source``; the last is ``name``."""
    return f"""
{name}_1 AS (SELECT *, regexp_replace(lower({column}), '[^a-z]', '', 'g') AS plain FROM {source}),
{name}_2 AS (SELECT *, regexp_extract_all(plain, '{_GROUPS}') AS u FROM {name}_1),
{name}_3 AS (SELECT * EXCLUDE (u), coalesce(array_to_string(list_transform(u, lambda t, i: CASE WHEN t = 'c' THEN
  CASE WHEN substr(coalesce(u[i + 1], ''), 1, 1) IN ('e', 'i', 'y') THEN 's' ELSE 'k' END ELSE coalesce(({_MAP})[t], t) END), ''), '') AS s FROM {name}_2),
{name}_4 AS (SELECT * EXCLUDE (s), regexp_extract_all(replace(replace(s, 'iya', 'ia'), 'ya', 'ia'), '.') AS c FROM {name}_3),
{name}_5 AS (SELECT * EXCLUDE (c), coalesce(array_to_string(list_filter(c, lambda x, i: i = 1 OR x <> c[i - 1]), ''), '') AS strict FROM {name}_4),
{name}_6 AS (SELECT *, substr(strict, 1, 1) || regexp_replace(substr(strict, 2), '[aeiou]', '', 'g') AS loose FROM {name}_5),
{name} AS (SELECT *, translate(loose, 'vw', 'bb') AS fuzzy FROM {name}_6)"""


_WORDS = f"words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_CONTENT}')) AS word FROM documents)"
_LOWER = "lowered AS (SELECT DISTINCT lower(word) AS w FROM words)"


def _collisions(key: str) -> str:
    return f"""WITH {_WORDS}, {_LOWER}, {strict_ctes("lowered", "w", "k")}
SELECT {key} AS key, count(*) AS n, string_agg(w, ',' ORDER BY w) AS words FROM k WHERE {key} <> '' GROUP BY 1 HAVING count(*) > 1"""


_PROTECTED = [p.replace("(?iU)", "(?i)").replace("(?U)", "").replace("(?<!\\w)", "\\B") for p in text.PROTECTED]


def _found(key: str, column: str, source: str, patterns: list[str] = _PROTECTED) -> str:
    """(key, r): place and length of each match of each pattern."""
    parts = []
    for p in patterns:
        found, gaps = f"regexp_extract_all({column}, '{p}')", f"string_split_regex({column}, '{p}')"
        parts.append(f"""SELECT {key} AS key, unnest(list_transform({found}, lambda x, i: [
  list_sum(list_transform({gaps}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform({found}[1:i - 1], lambda y: length(y))), 0), length(x)])) AS r FROM {source}""")
    return " UNION ALL ".join(parts)


_TURNS = "turns AS (SELECT conv_id * 1000 + turn AS utt_id, coalesce(text, '') || ' www.' || regexp_extract(lower(coalesce(text, '')), '[a-z]{9,}') || '.com' AS text FROM conversations)"
_TOKENS = f"""{_TURNS},
t_1 AS (SELECT *, regexp_extract_all(text, '{_WORD}') AS m, string_split_regex(text, '{_WORD}') AS g FROM turns),
t_2 AS (SELECT utt_id, text, unnest(m) AS word, unnest(list_transform(m, lambda x, i: list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0)))::INTEGER AS start,
  generate_subscripts(m, 1) AS idx FROM t_1 WHERE len(m) > 0),
t_3 AS (SELECT utt_id, text, start, start + length(word) AS "end", idx, regexp_extract(word, '([''’]s|[''’])$', 1) AS suffix, word FROM t_2),
tokens AS (SELECT utt_id, text, start::INTEGER AS start, "end"::INTEGER AS "end", suffix, substr(word, 1, length(word) - length(suffix)) AS stem,
  (row_number() OVER (PARTITION BY utt_id ORDER BY idx) - 1)::INTEGER AS pos FROM t_3 WHERE length(word) > length(suffix))"""
_NGRAMS = """grams AS (
  SELECT a.utt_id, 1 AS n, a.pos AS first, a.start, a."end", a.stem AS stem, [a.stem] AS parts FROM tokens a
  UNION ALL SELECT a.utt_id, 2, a.pos, a.start, b."end", a.stem || ' ' || b.stem, [a.stem, b.stem] FROM tokens a JOIN tokens b ON a.utt_id = b.utt_id AND b.pos = a.pos + 1
  UNION ALL SELECT a.utt_id, 3, a.pos, a.start, c."end", a.stem || ' ' || b.stem || ' ' || c.stem, [a.stem, b.stem, c.stem] FROM tokens a
    JOIN tokens b ON a.utt_id = b.utt_id AND b.pos = a.pos + 1 JOIN tokens c ON a.utt_id = c.utt_id AND c.pos = a.pos + 2)"""
_TERMS = """found AS (SELECT unnest(regexp_extract_all(lower(text), '[a-zß-ÿ]+')) AS word FROM conversations),
numbered AS (SELECT DISTINCT word, ('0x' || substr(md5(word), 1, 13))::BIGINT AS entry_id FROM found WHERE length(word) >= 9 AND regexp_full_match(word, '[a-z]+')),
entries AS (SELECT entry_id, upper(substr(word, 1, 1)) || substr(word, 2) AS canonical, word, (['person', 'product', 'term', 'acronym'])[entry_id % 4 + 1] AS kind,
  CASE WHEN entry_id % 11 = 0 THEN 'suppressed' WHEN entry_id % 7 = 0 THEN 'candidate' ELSE 'active' END AS status,
  round_even(CAST(CAST((entry_id % 5 + 1.0::DOUBLE) / (entry_id % 5 + entry_id % 2 + 2.0::DOUBLE) AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS confidence FROM numbered),
surfaces AS (SELECT DISTINCT entry_id, unnest([canonical, replace(replace(word, 't', 'th'), 'a', 'aa')]) AS surface FROM entries),
context AS (SELECT * FROM (SELECT entry_id, lead(word) OVER (PARTITION BY substr(word, 1, 1) ORDER BY word) AS term, 2.0::DOUBLE AS weight FROM entries) WHERE term IS NOT NULL)"""
_KEYED = f"""{_TOKENS}, {_NGRAMS}, {_TERMS}, {strict_ctes("(SELECT DISTINCT stem FROM tokens)", "stem", "tk")}, {strict_ctes("surfaces", "surface", "sk")},
keys AS (SELECT DISTINCT entry_id, unnest([strict, loose, fuzzy]) AS key, unnest(['indic', 'indic_loose', 'indic_fuzzy']) AS algo FROM sk),
p_1 AS (SELECT utt_id, n, first, start, "end", stem, unnest(parts) AS part, generate_subscripts(parts, 1) AS idx FROM grams),
spans AS (SELECT utt_id, n, first, start, "end", p_1.stem AS stem, string_agg(strict, '' ORDER BY idx) AS strict, string_agg(loose, '' ORDER BY idx) AS loose, string_agg(fuzzy, '' ORDER BY idx) AS fuzzy
  FROM p_1 JOIN tk ON tk.stem = p_1.part GROUP BY ALL),
lookups AS (SELECT utt_id, start, "end", n, first, stem, unnest([strict, loose, fuzzy]) AS key, unnest(['indic', 'indic_loose', 'indic_fuzzy']) AS algo, unnest([0, 2, 3]) AS rank FROM spans),
hits AS (SELECT utt_id, start, "end", n, first, stem, entry_id, min(rank) AS rank FROM lookups JOIN keys USING (key, algo) WHERE key <> '' GROUP BY ALL),
ranges AS (SELECT key AS utt_id, r[1] AS a, r[1] + r[2] AS b FROM ({_found("utt_id", "text", "turns")})),
guards AS (SELECT DISTINCT h.utt_id, h.start, h."end", h.n, h.first FROM hits h JOIN ranges g ON g.utt_id = h.utt_id AND h.start < g.b AND h."end" > g.a),
all_routed AS (SELECT h.*, CASE rank WHEN 0 THEN 'indic' WHEN 2 THEN 'indic_loose' ELSE 'indic_fuzzy' END AS route, g.utt_id IS NOT NULL AS guarded
  FROM hits h LEFT JOIN guards g ON g.utt_id = h.utt_id AND g.start = h.start AND g."end" = h."end"),
routed AS (SELECT * FROM all_routed WHERE NOT guarded)"""
_SCORED = f"""{_KEYED}, {strict_ctes("(SELECT DISTINCT stem FROM routed)", "stem", "hk")},
near AS (SELECT r.utt_id, r.start, r."end", r.stem, r.entry_id, max(CASE WHEN hk.strict = '' OR sk.strict = '' THEN 0.0::DOUBLE ELSE
    round_even(CAST(CAST(0.75::DOUBLE * {winkler('hk.strict', 'sk.strict')} + 0.25::DOUBLE * {winkler('hk.plain', 'sk.plain')} AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE END) AS best
  FROM routed r JOIN hk ON hk.stem = r.stem JOIN sk ON sk.entry_id = r.entry_id WHERE r.rank > 0 GROUP BY ALL),
sounds AS (SELECT DISTINCT t.utt_id, unnest([tk.strict, tk.loose]) AS sound FROM tokens t JOIN tk ON tk.stem = t.stem),
{strict_ctes("context", "term", "ck")},
weights AS (SELECT entry_id, sound, max(weight) AS weight FROM (SELECT entry_id, weight, unnest([strict, loose]) AS sound FROM ck) WHERE sound <> '' GROUP BY ALL),
boosts AS (SELECT utt_id, entry_id, least(1.0::DOUBLE, sum(weight) / 3.0::DOUBLE) AS boost FROM weights JOIN sounds USING (sound) GROUP BY ALL),
c_1 AS (SELECT r.*, e.canonical, e.kind, e.status, e.confidence, coalesce(b.boost, 0.0::DOUBLE) AS boost,
    CASE r.rank WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN n.best * 0.85::DOUBLE ELSE n.best * 0.80::DOUBLE END AS sim
  FROM routed r JOIN entries e USING (entry_id) LEFT JOIN boosts b ON b.utt_id = r.utt_id AND b.entry_id = r.entry_id
  LEFT JOIN near n ON n.utt_id = r.utt_id AND n.start = r.start AND n."end" = r."end" AND n.stem = r.stem AND n.entry_id = r.entry_id
  WHERE (r.rank = 0 OR n.best >= 0.60) AND (r.rank <> 3 OR coalesce(b.boost, 0) > 0)),
scored AS (SELECT *, round_even(CAST(CAST(sim AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS similarity, round_even(CAST(CAST(boost AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS context_boost,
  round_even(CAST(CAST(least(1.0::DOUBLE, sim * (0.75::DOUBLE + 0.25::DOUBLE * confidence) + 0.10::DOUBLE * boost) AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS score FROM c_1)"""
_RANKED = f"""{_SCORED},
placed AS (SELECT *, row_number() OVER (PARTITION BY utt_id, start, "end" ORDER BY score DESC, rank, entry_id) AS place FROM scored),
tops AS (SELECT a.*, b.score AS runner_up FROM placed a LEFT JOIN placed b ON b.utt_id = a.utt_id AND b.start = a.start AND b."end" = a."end" AND b.place = 2 WHERE a.place = 1)"""
_RENDERED = """CASE WHEN kind = 'acronym' THEN canonical WHEN length(stem) > 1 AND upper(stem) = stem AND lower(stem) <> stem THEN upper(canonical) ELSE canonical END"""

_JUDGED = f"""{_RANKED}, common AS (SELECT word FROM entries WHERE entry_id % 5 = 0), {strict_ctes("common", "word", "mk")},
rights AS (SELECT utt_id, start, "end", arg_min(entry_id, place) AS right_id, arg_min(score, place) AS right_score FROM placed WHERE status = 'active' AND {_RENDERED} = stem GROUP BY ALL),
judged AS (SELECT t.*, r.right_id, r.right_score, (lower(t.stem) IN (SELECT word FROM common) OR hk.strict IN (SELECT strict FROM mk WHERE strict <> '')) AS is_common
  FROM tops t JOIN hk ON hk.stem = t.stem LEFT JOIN rights r ON r.utt_id = t.utt_id AND r.start = t.start AND r."end" = t."end"),
decisions AS (SELECT *, CASE WHEN right_id IS NOT NULL THEN 'noop_already_correct' WHEN status = 'suppressed' THEN 'abstain_suppressed' WHEN status = 'candidate' THEN 'abstain_low_evidence'
  WHEN score < 0.72 THEN 'abstain_low_score' WHEN runner_up IS NOT NULL AND score - runner_up < 0.06::DOUBLE THEN 'abstain_ambiguous' WHEN is_common AND context_boost <= 0 THEN 'abstain_common_word' ELSE 'apply' END AS action FROM judged)"""
# the greedy pass: decisions of an utterance in turn, each kept if it meets no kept one
_RESOLVED = f"""{_JUDGED},
every AS (SELECT utt_id, start, "end", n, first, stem, action, coalesce(right_id, entry_id) AS about, coalesce(right_score, score) AS shown, CASE WHEN right_id IS NULL THEN runner_up END AS second, {_RENDERED} AS said FROM decisions
  UNION ALL SELECT utt_id, start, "end", n, first, NULL, 'abstain_protected_span', NULL, NULL, NULL, NULL FROM guards),
turned AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY n DESC, first) AS k FROM every),
pass(utt_id, k, held) AS (SELECT utt_id, 1::BIGINT, [[start, "end"]] FROM turned WHERE k = 1 UNION ALL
  SELECT p.utt_id, t.k, CASE WHEN len(list_filter(p.held, lambda x: x[1] < t."end" AND x[2] > t.start)) = 0 THEN list_append(p.held, [t.start, t."end"]) ELSE p.held END
  FROM pass p JOIN turned t ON t.utt_id = p.utt_id AND t.k = p.k + 1),
ends AS (SELECT utt_id, unnest(arg_max(held, k)) AS x FROM pass GROUP BY utt_id),
kept AS (SELECT t.*, substr(u.text, t.start + 1, t."end" - t.start) AS span FROM turned t JOIN ends e ON e.utt_id = t.utt_id AND e.x[1] = t.start AND e.x[2] = t."end" JOIN turns u ON u.utt_id = t.utt_id),
edits AS (SELECT utt_id, start, "end", said || CASE WHEN starts_with(span, stem) THEN substr(span, length(stem) + 1) ELSE '' END AS said,
  coalesce(lag("end") OVER (PARTITION BY utt_id ORDER BY start), 0) AS since FROM kept WHERE action = 'apply'),
pieces AS (SELECT e.utt_id, string_agg(substr(u.text, since + 1, start - since) || said, '' ORDER BY start) AS head, max("end") AS upto FROM edits e JOIN turns u ON u.utt_id = e.utt_id GROUP BY e.utt_id),
numbers AS (SELECT utt_id, count(*)::INTEGER AS n_decisions FROM kept GROUP BY utt_id),
resolved AS (SELECT u.utt_id, coalesce(p.head || substr(u.text, p.upto + 1), u.text) AS memory_aware, p.utt_id IS NOT NULL AS intervened, coalesce(c.n_decisions, 0)::INTEGER AS n_decisions
  FROM turns u LEFT JOIN pieces p ON p.utt_id = u.utt_id LEFT JOIN numbers c ON c.utt_id = u.utt_id)"""

_EVIDENCE = """born AS (SELECT entry, min(seq) FILTER (effect IN ('confirm', 'add')) AS entry_id, min(seq) FILTER (effect = 'add') AS first_add FROM fx GROUP BY entry),
ev AS (SELECT entry, entry_id, first_add, count(*) FILTER (effect IN ('confirm', 'use')) AS c, count(*) FILTER (effect IN ('confirm', 'use') AND seq > first_add) AS u,
  count(*) FILTER (effect = 'revert') AS contradictions, count(*) FILTER (effect = 'apply') AS applications
  FROM fx JOIN born USING (entry) WHERE seq >= entry_id GROUP BY ALL),
ev2 AS (SELECT *, first_add IS NOT NULL AS protected, CASE WHEN first_add IS NOT NULL THEN greatest(c, u + 2) ELSE c END AS confirmations FROM ev),
ev3 AS (SELECT *, round_even(CAST(CAST(CASE WHEN protected THEN greatest((confirmations + 1.0::DOUBLE) / (confirmations + contradictions + 2.0::DOUBLE), 0.95::DOUBLE)
  ELSE (confirmations + 1.0::DOUBLE) / (confirmations + contradictions + 2.0::DOUBLE) END AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS confidence,
  CASE WHEN protected THEN 'active' WHEN contradictions >= 2 THEN 'suppressed' WHEN confirmations >= 2 THEN 'active' ELSE 'candidate' END AS status FROM ev2)"""
_EFFECTS = """fx AS (SELECT user_id::VARCHAR AS entry, event_id AS seq, (MAP {'purchase': 'confirm', 'signup': 'add', 'view': 'use', 'error': 'revert', 'click': 'apply'})[event_type] AS effect FROM events),
""" + _EVIDENCE
_FIRST, _SECOND = r"^\P{L}*([A-Za-z]{3,})", r"^(?:\P{L}*\p{L}+)\P{L}*([A-Za-z]{3,})"
_FOLDED = f"""obs AS (SELECT conv_id * 1000 + turn AS seq, turn % 4 AS k, text, regexp_extract(text, '{_FIRST}', 1) AS w0, regexp_extract(text, '{_SECOND}', 1) AS w1 FROM conversations WHERE text IS NOT NULL),
named AS (SELECT seq, k, w0 AS name, lower(w0) AS entry FROM obs WHERE w0 <> '' AND (k = 2 OR k = 0 AND w1 <> '')),
names AS (SELECT entry, min(seq) AS made, arg_min(name, seq) AS canonical FROM named GROUP BY entry),
told AS (SELECT seq, unnest(regexp_extract_all(text, '{_CONTENT}')) AS raw FROM obs WHERE k = 1),
terms AS (SELECT DISTINCT seq, regexp_replace(regexp_replace(lower(raw), '[''’s]+$', ''), '^[''’-]+|[''’-]+$', '', 'g') AS term FROM told),
said AS (SELECT * FROM terms WHERE length(term) >= 3 AND term NOT IN ({_STOP})),
{strict_ctes("(SELECT DISTINCT term AS word FROM said UNION SELECT canonical FROM names)", "word", "fk")},
fx AS (SELECT entry, seq, CASE k WHEN 0 THEN 'confirm' ELSE 'add' END AS effect FROM named
  UNION ALL SELECT DISTINCT n.entry, s.seq, 'use' FROM said s JOIN fk a ON a.word = s.term JOIN fk b ON b.strict = a.strict JOIN names n ON n.canonical = b.word WHERE a.strict <> '' AND s.seq > n.made
  UNION ALL SELECT lower(w0), seq, 'revert' FROM obs WHERE k = 3 AND w0 <> ''),
""" + _EVIDENCE


_LABELLED = """o AS (SELECT lang, CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'useful' WHEN toxic = 0 THEN 'missed' ELSE 'wrong_target' END
  ELSE CASE WHEN toxic = 1 THEN 'correct_abstention' ELSE 'false_intervention' END END AS outcome FROM labels JOIN documents USING (doc_id)),"""
_EXACT = f"""xpairs AS (SELECT lower(surface) AS surface, arg_max(canonical, entry_id) AS canonical FROM surfaces JOIN entries USING (entry_id) WHERE lower(surface) <> lower(canonical) GROUP BY 1),
xtable AS (SELECT map_from_entries(list((surface, canonical))) AS m FROM xpairs),
xcut AS (SELECT utt_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w, string_split_regex(text, '[\\p{{L}}\\p{{N}}_]+') AS g FROM turns),
xout AS (SELECT utt_id, array_to_string(list_transform(g, lambda x, i: x || coalesce(m[lower(w[i])], w[i], '')), '') AS replaced FROM xcut, xtable)"""
# cases: long words in lower case are expected with a capital, and misspelt in every other turn
_SPOKEN = """spoken AS (SELECT conv_id * 1000 + turn AS utt_id, turn % 2 = 0 AS noisy, coalesce(text, '') AS said FROM conversations),
bits AS (SELECT *, list_transform(regexp_extract_all(said, '[\\p{L}\\p{N}_]+'), lambda w: {'w': w, 'long': regexp_full_match(w, '[a-z]{9,}')}) AS w, string_split_regex(said, '[\\p{L}\\p{N}_]+') AS g FROM spoken),
sides AS (SELECT utt_id, ' www.' || regexp_extract(lower(said), '[a-z]{9,}') || '.com' AS address,
  array_to_string(list_transform(g, lambda x, i: x || coalesce(CASE WHEN w[i].long THEN upper(w[i].w[1]) || substr(w[i].w, 2) ELSE w[i].w END, '')), '') AS good,
  array_to_string(list_transform(g, lambda x, i: x || coalesce(CASE WHEN w[i].long AND noisy THEN replace(replace(w[i].w, 't', 'th'), 'a', 'aa') ELSE w[i].w END, '')), '') AS bad FROM bits),
turns AS (SELECT utt_id, bad || address AS text FROM sides)"""
_STRATEGIES = f"""{_RESOLVED.replace(_TURNS, _SPOKEN, 1)}, {_EXACT},
wanted AS (SELECT utt_id, bad || address AS text, good || address AS expected FROM sides),
acts AS (SELECT utt_id, 'none' AS strategy, text AS actual FROM turns UNION ALL SELECT utt_id, 'exact_dict', replaced FROM xout UNION ALL SELECT utt_id, 'phonetic', memory_aware FROM resolved),
o AS (SELECT strategy, CASE WHEN expected <> text THEN CASE WHEN actual = expected THEN 'useful' WHEN actual = text THEN 'missed' ELSE 'wrong_target' END
  ELSE CASE WHEN actual = expected THEN 'correct_abstention' ELSE 'false_intervention' END END AS outcome FROM acts JOIN wanted USING (utt_id)),
"""


def _metrics(by: str) -> str:
    return f"""c AS (SELECT {by}, count(*) AS cases, count(*) FILTER (outcome = 'useful') AS useful, count(*) FILTER (outcome = 'missed') AS missed, count(*) FILTER (outcome = 'wrong_target') AS wrong_target,
  count(*) FILTER (outcome = 'correct_abstention') AS correct_abstention, count(*) FILTER (outcome = 'false_intervention') AS false_intervention FROM o GROUP BY {by}),
q AS (SELECT *, CASE WHEN useful + wrong_target + false_intervention = 0 THEN 0.0::DOUBLE ELSE useful::DOUBLE / (useful + wrong_target + false_intervention) END AS p,
  CASE WHEN useful + missed + wrong_target = 0 THEN 0.0::DOUBLE ELSE useful::DOUBLE / (useful + missed + wrong_target) END AS r FROM c)
SELECT {by}, cases, useful, missed, wrong_target, correct_abstention, false_intervention, round_even(CAST(CAST((useful + correct_abstention)::DOUBLE / cases AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS pass_rate,
  round_even(CAST(CAST(p AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS precision, round_even(CAST(CAST(r AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS recall, CASE WHEN p + r = 0 THEN 0.0::DOUBLE ELSE round_even(CAST(CAST(2 * p * r / (p + r) AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE END AS f1 FROM q"""

_SURFACES = f"""{_FOLDED},
written AS (SELECT entry, made AS seq, 0 AS step, canonical AS surface, 'canonical' AS origin FROM names UNION ALL SELECT entry, seq, 1, name, 'canonical' FROM named
  UNION ALL SELECT n.entry, n.seq, 2, o.w1, 'observed' FROM named n JOIN obs o ON o.seq = n.seq WHERE n.k = 0),
folded AS (SELECT made AS entry_id, surface, arg_min(origin, seq * 10 + step) AS origin, count(*) AS count FROM written JOIN names USING (entry) GROUP BY ALL)"""


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL: dict[str, str] = {
    "strict_skeleton": f"WITH {_WORDS}, {strict_ctes('words', 'word', 'k')} SELECT word, strict, loose, fuzzy FROM k",
    "key_collisions_strict": _collisions("strict"),
    "key_collisions_loose": _collisions("loose"),
    "collision_summary": f"""WITH {_WORDS}, {_LOWER}, {strict_ctes("lowered", "w", "k")},
s AS (SELECT strict, count(*) AS n FROM k WHERE strict <> '' GROUP BY 1 HAVING count(*) > 1),
l AS (SELECT loose, count(*) AS n FROM k WHERE loose <> '' GROUP BY 1 HAVING count(*) > 1)
SELECT (SELECT count(*) FROM lowered) AS words, (SELECT count(*) FROM s) AS strict_groups, (SELECT count(*) FROM l) AS loose_groups, (SELECT coalesce(max(n), 0) FROM l) AS largest_loose""",
    "phonetic_similarity": f"""WITH p AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part), w AS (SELECT word FROM p WHERE word <> '' UNION SELECT replace(word, 'e', 'ee') FROM p WHERE word <> ''),
{strict_ctes("w", "word", "k")}
SELECT a.word AS a, b.word AS b, round_even(CAST(CAST(0.75::DOUBLE * {winkler('a.strict', 'b.strict')} + 0.25::DOUBLE * {winkler('a.plain', 'b.plain')} AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS similarity
FROM k a JOIN k b ON a.loose = b.loose AND a.word < b.word WHERE a.loose <> ''""",
    "devanagari_keys": "SELECT * FROM (VALUES ('सत्य', 'satia'), ('कृष्ण', 'krisna'), ('सर्विस', 'sarvis'), ('नमस्ते', 'namaste'), ('कमल', 'kamal'), ('राम', 'ram')) v(word, strict)",
    "tokenize_offsets": f'WITH {_TOKENS} SELECT utt_id, pos, start, "end", stem, suffix FROM tokens',
    "ngram_spans": f'WITH {_TOKENS}, {_NGRAMS} SELECT utt_id, n, first, start, "end", stem FROM grams',
    "protected_spans": " UNION ALL ".join(f"""SELECT key AS page_id, '{c}' AS part, r[1]::INTEGER AS start, (r[1] + r[2])::INTEGER AS "end" FROM ({_found("page_id", c, "pages")})""" for c in ("url", "html")),
    "context_top25": f"""WITH w AS (SELECT source, unnest(regexp_extract_all(coalesce(text, ''), '{_CONTENT}')) AS raw FROM documents),
c AS (SELECT source, regexp_replace(regexp_replace(lower(raw), '[''’s]+$', ''), '^[''’-]+|[''’-]+$', '', 'g') AS term FROM w),
n AS (SELECT source, term, count(*)::DOUBLE AS weight FROM c WHERE length(term) >= 3 AND term NOT IN ({_STOP}) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS k FROM n)
SELECT source, term, weight FROM r WHERE k <= 25""",
    "retrieve_candidates": f'WITH {_KEYED} SELECT utt_id, start, "end", stem, entry_id, route, guarded FROM all_routed',
    "candidates_per_span": f"""WITH {_KEYED}, c AS (SELECT utt_id, start, "end", count(*) AS n FROM all_routed GROUP BY ALL)
SELECT count(*) AS spans, round_even(CAST(CAST(sum(n)::DOUBLE / count(*) AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS mean, max(n) AS most FROM c""",
    "score_candidates": f'WITH {_SCORED} SELECT utt_id, start, "end", entry_id, route, similarity, context_boost, score FROM scored',
    "top_two": f'WITH {_RANKED} SELECT utt_id, start, "end", entry_id AS winner, score, runner_up FROM tops',
    "decide_policy": f'WITH {_JUDGED} SELECT utt_id, start, "end", action, coalesce(right_id, entry_id) AS entry_id, coalesce(right_score, score) AS score FROM decisions',
    "decision_trace": f"""WITH RECURSIVE {_RESOLVED} SELECT utt_id, start, "end", span, action, about AS entry_id, shown AS score, second AS runner_up FROM kept""",
    "resolve_text": f"WITH RECURSIVE {_RESOLVED} SELECT utt_id, memory_aware, intervened, n_decisions FROM resolved",
    "resolve_branches": f"WITH RECURSIVE {_RESOLVED} SELECT action, count(DISTINCT utt_id) AS cases FROM kept GROUP BY action",
    "adversarial_rates": f"""WITH RECURSIVE {_RESOLVED} SELECT role, count(*) AS sentences, count(*) FILTER (intervened) AS interventions,
  round_even(CAST(CAST(count(*) FILTER (intervened)::DOUBLE / count(*) AS VARCHAR) AS DECIMAL(38, 20)), 4)::DOUBLE AS rate FROM resolved JOIN conversations ON utt_id = conv_id * 1000 + turn GROUP BY role""",
    "exact_dict_replace": f"WITH {_TURNS}, {_TERMS}, {_EXACT} SELECT utt_id, replaced FROM xout",
    "observation_fold": f"""WITH {_FOLDED} SELECT entry_id, canonical, 'term' AS kind, status, confidence, protected, confirmations, contradictions FROM ev3 JOIN names USING (entry)""",
    "folded_surfaces": f"WITH {_SURFACES} SELECT entry_id, surface, origin, count FROM folded",
    "folded_keys": f"""WITH {_SURFACES}, {strict_ctes("(SELECT DISTINCT surface FROM folded)", "surface", "gk")},
spelt AS (SELECT DISTINCT entry_id, unnest([strict, loose, fuzzy]) AS key, unnest(['indic', 'indic_loose', 'indic_fuzzy']) AS algo FROM folded JOIN gk USING (surface))
SELECT entry_id, key, algo FROM spelt WHERE key <> ''""",
    "prompt_block": f"""WITH {_KEYED},
heard AS (SELECT entry_id, string_agg(DISTINCT surface, ', ' ORDER BY surface) AS variants FROM surfaces JOIN entries USING (entry_id) WHERE lower(surface) <> lower(canonical) GROUP BY entry_id),
lines AS (SELECT entry_id, canonical, '- ' || canonical || ' [' || kind || ']' || coalesce(' (heard as: ' || variants || ')', '') AS line FROM entries LEFT JOIN heard USING (entry_id) WHERE status = 'active'),
met AS (SELECT DISTINCT t.utt_id, k.entry_id FROM tokens t JOIN tk ON tk.stem = t.stem JOIN keys k ON k.key = tk.strict AND k.algo = 'indic' WHERE tk.strict <> ''),
blocks AS (SELECT utt_id, string_agg(line, chr(10) ORDER BY canonical, entry_id) AS lines FROM met JOIN lines USING (entry_id) GROUP BY utt_id)
SELECT utt_id, '# Known personal terms' || chr(10) || coalesce(lines, '(none relevant to this utterance)') AS block FROM turns LEFT JOIN blocks USING (utt_id)""",
    "lifecycle_status": f"WITH {_EFFECTS} SELECT entry, entry_id, confirmations, contradictions, applications, protected, confidence, status FROM ev3",
    "status_counts": f"WITH {_EFFECTS} SELECT status, count(*) AS n FROM ev3 GROUP BY status",
    "surface_counts": "SELECT user_id AS entry_id, event_type AS surface, arg_min(json_extract_string(props, '$.k'), event_id) AS origin, count(*) AS count FROM events GROUP BY 1, 2",
    "trace_retention": """WITH l AS (SELECT user_id, max(event_id) AS last FROM events GROUP BY 1), k AS (SELECT user_id FROM l QUALIFY row_number() OVER (ORDER BY last DESC) <= 50 OR (SELECT count(*) FROM l) <= 100)
SELECT user_id AS request_id, event_id AS id, event_type AS action, value AS score FROM events WHERE user_id IN (SELECT user_id FROM k)""",
    "recent_decisions": """WITH l AS (SELECT user_id, max(event_id) AS last_id, count(*)::INTEGER AS n, arg_max(event_type, event_id) AS last_action FROM events GROUP BY 1)
SELECT user_id AS request_id, n, last_id, last_action FROM l QUALIFY row_number() OVER (ORDER BY last_id DESC) <= 40""",
    "outcome_metrics": "WITH " + _LABELLED + _metrics("lang"),
    "strategy_metrics": "WITH RECURSIVE " + _STRATEGIES + _metrics("strategy"),
    "branch_coverage": "SELECT event_type AS action, count(DISTINCT user_id) AS cases FROM events GROUP BY 1",
    "uncovered_branches": """SELECT action FROM (VALUES ('purchase'), ('view'), ('apply'), ('noop_already_correct'), ('abstain_suppressed'), ('abstain_low_evidence'), ('abstain_low_score'),
  ('abstain_ambiguous'), ('abstain_common_word'), ('abstain_protected_span')) v(action) WHERE action NOT IN (SELECT event_type FROM events)""",
    "latency_percentiles": """WITH l AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[least(len(v) - 1, floor(len(v) * 0.5::DOUBLE)::BIGINT) + 1] AS p50, v[least(len(v) - 1, floor(len(v) * 0.95::DOUBLE)::BIGINT) + 1] AS p95, v[len(v)] AS max, len(v) AS count FROM l""",
    "table_stats": "WITH t AS (" + " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows FROM {t}" for t in _TABLES) + ") SELECT * FROM t UNION ALL SELECT 'total', sum(rows)::BIGINT FROM t",
    "validate_observations": """WITH o AS (SELECT event_id AS seq, (MAP {'purchase': 'correction', 'signup': 'dictionary_add', 'view': 'usage', 'error': 'revert', 'click': 'nonsense'})[event_type] AS kind,
  event_id % 3 = 0 AS blank, CASE event_id % 5 WHEN 0 THEN 'wizard' ELSE 'term' END AS entry_kind FROM events)
SELECT seq, kind, entry_kind, CASE WHEN kind = 'nonsense' THEN 'unknown kind: nonsense' WHEN blank THEN (MAP {'correction': 'before', 'dictionary_add': 'canonical', 'usage': 'text', 'revert': 'applied'})[kind] || ' is empty'
  WHEN kind IN ('correction', 'dictionary_add') AND entry_kind = 'wizard' THEN 'unknown entry kind: wizard' END AS problem FROM o""",
    "key_join": f"WITH {_TERMS} SELECT surface, canonical FROM surfaces JOIN entries USING (entry_id)",
}
