"""The SQL of the queries that SQL can express, built from the operators' own tables and marks."""

from __future__ import annotations

from collections.abc import Sequence

from keyweave.llm import chat, divergence, imatch, quality


def _text(value: str) -> str:
    return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def chat_sql() -> str:
    def escaped(column: str) -> str:
        return rf"replace(replace({column}, '\', '\\'), '<|', '<\|')"

    added = ", ".join(f"({c}, {turn}, {_text(role)}, {_text(text)})" for c, turn, role, text in chat.ADDED)
    around = len(chat.TURN) + len(chat.TEXT) + len(chat.END)
    return f"""
WITH given AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations
  UNION ALL SELECT * FROM (VALUES {added}) AS v(conv_id, turn, role, text)
), cleaned AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM given
), placed AS (
  SELECT *, row_number() OVER w AS nr, lag(role) OVER w AS before FROM cleaned
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{chat.LEARNED_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (WHERE role = '{chat.LEARNED_ROLE}'), '')) AS loss_sha256,
       CAST(sum(length({escaped("text")}) + CASE WHEN before = role THEN {len(chat.MORE)}
                ELSE {around} + length({escaped("role")}) END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id"""


def quality_sql(
    base: Sequence[quality.Rule] = quality.BASE_RULES, rules: Sequence[quality.Rule] = quality.RULES
) -> str:
    space = r"[^\x20\x09-\x0D]"
    stop = ", ".join(map(_text, sorted(set(quality.STOP_WORDS))))
    code = "regexp_replace(lower(substring(lang, 1, 3)), '[^a-z].*$', '')"

    def ratio(part: str, whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN {part} / CAST({whole} AS DOUBLE) ELSE 0 END"

    def judged(rule: quality.Rule) -> str:
        tests = [f"{rule.measure} < {rule.least}"] if rule.least is not None else []
        tests += [f"{rule.measure} > {rule.most}"] if rule.most is not None else []
        languages = ", ".join(map(_text, rule.languages))
        return f"(({' OR '.join(tests)}) AND {f'coalesce({code} IN ({languages}), TRUE)' if languages else 'TRUE'})"

    def broken(table: Sequence[quality.Rule]) -> str:
        return "(" + " OR ".join(map(judged, table)) + ")"

    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS nr, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, lang FROM documents
), cut AS (
  SELECT nr, doc_id, text, lang, regexp_extract_all(text, '{space}+') AS words,
         list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '{space}')) AS lines
  FROM docs
), windows AS (
  SELECT nr, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS three
  FROM (SELECT nr, words, unnest(range(1, len(words) - 1)) AS i FROM cut)
), again AS (
  SELECT nr, i FROM windows SEMI JOIN (SELECT nr, three FROM windows GROUP BY ALL HAVING count(*) > 1) USING (nr, three)
), covered AS (
  SELECT nr, count(DISTINCT word) AS n_repeat_words
  FROM (SELECT nr, unnest([i, i + 1, i + 2]) AS word FROM again) GROUP BY nr
), counted AS (
  SELECT doc_id, lang, len(words) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '{quality.SYMBOLS}')) AS n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(words, lambda w: list_contains([{stop}], lower(w)))) AS n_stop_words
  FROM cut LEFT JOIN covered USING (nr)
), measured AS (
  SELECT *, 100 * ({ratio("n_repeat_words", "n_words")}) AS repeat_percent,
         {ratio("word_chars", "n_words")} AS mean_word_chars, {ratio("n_symbols", "n_words")} AS symbols_per_word,
         {ratio("n_stop_words", "n_words")} AS stop_word_share, {ratio("n_dup_lines", "n_lines")} AS dup_line_share
  FROM counted
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       {broken(base)} AS base_failed, NOT {broken([*base, *rules])} AS kept
FROM measured"""


def divergence_sql(settings: divergence.Settings | None = None) -> str:
    s = settings or divergence.Settings()
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    difference = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"

    def share(n: str, total: str) -> str:
        return f"1 + (CAST({s.scale} AS HUGEINT) * (CAST({n} AS HUGEINT) + 2)) // ({total} + 2 * v)"

    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS nr, translate(coalesce(text, ''), '{upper}', '{lower}') AS text,
         coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), words AS (
  SELECT nr, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT nr) >= {s.least_documents}
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), pool AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM counted GROUP BY lang, term
), langs AS (
  SELECT lang, count(*) AS v, CAST(sum(n) AS HUGEINT) AS total FROM pool GROUP BY lang
), totals AS (
  SELECT lang, source, CAST(coalesce(sum(n), 0) AS HUGEINT) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN counted USING (lang, source) GROUP BY lang, source
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, {share("coalesce(c.n, 0)", "t.total")} AS p
  FROM totals t JOIN kept k USING (lang) JOIN langs USING (lang)
  LEFT JOIN counted c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), q AS (
  SELECT pool.lang, term, {share("n", "total")} AS q FROM pool JOIN langs USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum({difference.format(p="a.p", q="b.p")}) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), shares AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT p.lang, source, 'term', term, {difference.format(p="p", q="q")} FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM shares
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {s.top_terms}"""


def imatch_sql(settings: imatch.Settings | None = None) -> str:
    s = settings or imatch.Settings()

    def drawn(level: int) -> str:
        digits = f"substring(md5(term), {4 * level + 1}, 4)"
        return f"CAST('0x' || {digits} AS INTEGER) % {imatch.SUBSETS << 2 * level}"

    subsets = "\n  UNION ALL ".join(
        f"SELECT term, lower(printf('%02x', {drawn(level)} + {imatch.SUBSETS * level})) AS subset "
        f"FROM lexicon WHERE {drawn(level)} < {imatch.SUBSETS}"
        for level in range(s.levels)
    )
    none = " || ".join(
        f"'{subset}' || substring(md5(text), {imatch.HASH_DIGITS * i + 1}, {imatch.HASH_DIGITS})"
        for i, subset in enumerate(imatch.NO_TERMS)
    )

    def entries(fingerprint: str) -> str:
        n, width = f"length({fingerprint})", imatch.SUBSET_DIGITS + imatch.HASH_DIGITS
        return f"list_transform(range(0, {n}, {width}), lambda i: substring({fingerprint}, CAST(i AS BIGINT) + 1, {width}))"

    def likeness(a: str, b: str) -> str:
        a, b = entries(a), entries(b)
        either = f"list_distinct(list_transform(list_concat({a}, {b}), lambda e: left(e, {imatch.SUBSET_DIGITS})))"
        equal = f"list_intersect({a}, {b})"
        levels = f"list_sort(list_distinct(list_transform({either}, lambda e: left(e, 1))))"

        def of_level(held: str) -> str:
            return f"len(list_filter({held}, lambda e: left(e, 1) = x))"

        shares = f"list_transform({levels}, lambda x: {of_level(equal)} / {of_level(either)})"
        return f"list_reduce({shares}, lambda p, q: p + q) / len({levels})"

    return rf"""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n,
         row_number() OVER (ORDER BY doc_id NULLS FIRST, text) - 1 AS nr, count(*) OVER () AS rows FROM documents
), edits AS (
  SELECT a.nr, a.doc_id, a.n, a.text, b.nr AS next_nr, left(a.text, a.n - a.n // 2) || left(b.text, a.n // 2) AS edited
  FROM given a JOIN given b ON b.nr = (a.nr + 1) % a.rows
), texts AS (
  SELECT nr, 0 AS version, text FROM edits UNION ALL SELECT nr, 1, edited FROM edits
), terms AS (
  SELECT DISTINCT nr, version, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+')) AS term FROM texts
), lexicon AS (
  SELECT term FROM terms WHERE version = 0 GROUP BY term
  HAVING ln((SELECT CAST(count(*) AS DOUBLE) FROM given) / count(*)) BETWEEN {s.lowest_idf} AND {s.highest_idf}
), subsets AS (
  {subsets}
), hashes AS (
  SELECT nr, version, subset, left(md5(string_agg(term, ' ' ORDER BY term)), {imatch.HASH_DIGITS}) AS hash
  FROM terms JOIN subsets USING (term) GROUP BY nr, version, subset
), found AS (
  SELECT nr, version, string_agg(subset || hash, '' ORDER BY subset) AS entries FROM hashes GROUP BY nr, version
), prints AS (
  SELECT nr, version, coalesce(entries, {none}) AS fingerprint FROM texts LEFT JOIN found USING (nr, version)
)
SELECT CAST(e.doc_id AS BIGINT) AS doc_id, CAST(e.n AS BIGINT) AS n_chars, sha256(e.edited) AS edited_sha256,
       a.fingerprint AS fingerprint, b.fingerprint AS edited_fingerprint,
       {likeness("a.fingerprint", "b.fingerprint")} AS near_edited, {likeness("a.fingerprint", "c.fingerprint")} AS near_next
FROM edits e JOIN prints a ON a.nr = e.nr AND a.version = 0 JOIN prints b ON b.nr = e.nr AND b.version = 1
JOIN prints c ON c.nr = e.next_nr AND c.version = 0"""
