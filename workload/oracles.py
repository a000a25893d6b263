"""SQL counterparts of the registered queries, built from shared common table expressions."""

from __future__ import annotations

from workload.inputs import LIST_SIZES, N_SEEDS, NEIGHBOURS, THRESHOLD

# Stated here again, so that the SQL does not depend on the code it checks.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
STOPWORDS = ["a", "an", "and", "for", "in", "of", "on", "the", "to", "with"]

# name -> (names it needs, SQL). A statement lists the names it reads; needs are added before them.
PARTS: dict[str, tuple[str, str]] = {}
RECURSIVE = {"walk"}


def part(name: str, needs: str, sql: str) -> None:
    PARTS[name] = (needs, sql)


def statement(needs: str, select: str, recursive: bool = False) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in PARTS[name][0].split():
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs.split():
        add(name)
    # every part is computed once; a recursive part cannot be marked so
    listed = ",\n".join(
        f"{name} AS {'' if name in RECURSIVE else 'MATERIALIZED '}({PARTS[name][1]})" for name in ordered
    )
    keyword = "WITH RECURSIVE " if recursive else "WITH "
    return (keyword + listed + "\n" if listed else "") + select


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- tokens, counts, vectors ---------------------------------------------------------------------

part("space", "", """
  SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word,
         generate_subscripts(string_split(lower(text), ' '), 1) - 1 AS pos FROM documents""")
part("runs", "", r"""
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word,
         generate_subscripts(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}'), 1) - 1 AS pos
  FROM documents""")
part("n", "", "SELECT count(*)::DOUBLE AS n FROM documents")
part("tf", "space", "SELECT doc_id, word, count(*) AS n FROM space GROUP BY ALL")
part("df", "tf", "SELECT word, count(*) AS df FROM tf GROUP BY word")
part("w", "tf df n", """
  SELECT doc_id, word, tf.n * (ln((SELECT n FROM n) / df) + 1) AS v FROM tf JOIN df USING (word)""")
part("plain", "w", """
  SELECT doc_id, word, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS value FROM w""")
part("vec", "runs", """
  SELECT word, embedding, label FROM embeddings JOIN (
    SELECT word, row_number() OVER (ORDER BY count(DISTINCT doc_id) DESC, word) - 1 AS vec_id
    FROM runs GROUP BY word) USING (vec_id)""")
part("unit", "vec", """
  SELECT word, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS u
  FROM (SELECT word, list_transform(embedding::DOUBLE[], lambda x: round(x, 9)) AS e FROM vec)""")
part("near", "unit", f"""
  SELECT * FROM (
    SELECT metaword, term, sim,
           row_number() OVER (PARTITION BY metaword ORDER BY metaword <> term, sim DESC, term) AS rank
    FROM (SELECT a.word AS metaword, b.word AS term,
                 round(list_dot_product(a.u, b.u), 12) AS sim FROM unit a CROSS JOIN unit b))
  WHERE rank <= {NEIGHBOURS}""")
part("nb", "near", f"""
  SELECT metaword, term, round(sim, 2) AS sim FROM near
  WHERE sim >= {THRESHOLD} AND round(sim, 2) <> 0""")


def cell_parts(suffix: str, tokens: str, neighbours: str) -> None:
    """Document cells, idf and TF-IDF for one choice of tokens and neighbours."""
    part(f"vtf{suffix}", f"{tokens} vec", f"""
  SELECT doc_id, word, count(*) AS n FROM {tokens} WHERE word IN (SELECT word FROM vec) GROUP BY ALL""")
    part(f"c{suffix}", f"vtf{suffix} {neighbours}", f"""
  SELECT doc_id, metaword, sum(n * sim) AS ctf, sum(n) FILTER (sim > 0) AS npos
  FROM vtf{suffix} t JOIN {neighbours} b ON b.term = t.word GROUP BY ALL""")
    part(f"idf{suffix}", f"c{suffix} vec n", f"""
  SELECT metaword, log10((SELECT n FROM n) / coalesce(nullif(sum(ctf / npos), 0), 0.001)) AS idf
  FROM (SELECT word AS metaword FROM vec) LEFT JOIN c{suffix} USING (metaword)
  GROUP BY metaword""")
    part(f"x{suffix}", f"c{suffix} idf{suffix}", f"""
  SELECT doc_id, metaword AS word, ctf * idf AS value FROM c{suffix} JOIN idf{suffix} USING (metaword)""")


cell_parts("", "space", "nb")
part("near_all", "unit", """
  SELECT * FROM (
    SELECT metaword, term, sim,
           row_number() OVER (PARTITION BY metaword ORDER BY metaword <> term, sim DESC, term) AS rank
    FROM (SELECT a.word AS metaword, b.word AS term,
                 round(list_dot_product(a.u, b.u), 12) AS sim FROM unit a CROSS JOIN unit b))
  WHERE rank <= 500""")
part("nb_default", "near_all", "SELECT metaword, term, round(sim, 2) AS sim FROM near_all WHERE sim >= 0.4")
cell_parts("_default", "space", "nb_default")
cell_parts("_runs", "runs", "nb")

# --- topics and word lists -----------------------------------------------------------------------

part("tw", "x vec", """
  SELECT label AS topic, word, round(sum(value), 4) AS weight FROM x JOIN vec USING (word) GROUP BY ALL""")
part("topic_ids", "", f"SELECT unnest(range({N_SEEDS}))::INTEGER AS topic")
part("dt", "x vec topic_ids", """
  SELECT doc_id, topic, coalesce(weight, 0.0) AS weight
  FROM documents CROSS JOIN topic_ids LEFT JOIN (
    SELECT doc_id, label AS topic, round(sum(value), 12) AS weight
    FROM x JOIN vec USING (word) GROUP BY ALL) USING (doc_id, topic)""")
part("ranked", "tw", """
  SELECT topic, word, weight, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, word) AS rank
  FROM tw""")
part("seeds", "ranked", f"SELECT topic, rank, word FROM ranked WHERE rank <= {max(LIST_SIZES)}")
part("long_words", "ranked", """
  SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY rank) AS rank
  FROM ranked WHERE rank <= 101 AND length(word) > 1""")
# jaro_similarity compares bytes; each accented letter becomes one spare ASCII character
part("plain_words", "long_words", """
  SELECT topic, rank, word, translate(word, 'ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ',
                                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&') AS s
  FROM long_words""")


def winkler(a: str, b: str) -> str:
    prefix = " + ".join(
        f"CASE WHEN left({a}, {i}) = left({b}, {i}) AND length({a}) >= {i} AND length({b}) >= {i} THEN 1 ELSE 0 END"
        for i in range(1, 5)
    )
    return f"(jaro_similarity({a}, {b}) + 0.1 * ({prefix}) * (1 - jaro_similarity({a}, {b})))"


part("lists", "plain_words", """
  SELECT topic, list(word ORDER BY rank) AS words, list(s ORDER BY rank) AS ss FROM plain_words GROUP BY topic""")
part("walk", "lists", f"""
  SELECT topic, words, ss, 1 AS place, []::BIGINT[] AS kept FROM lists
  UNION ALL
  SELECT topic, words, ss, place + 1,
         CASE WHEN len(list_filter(kept, lambda i: {winkler('ss[i]', 'ss[place]')} > 0.75)) = 0
              THEN list_append(kept, place::BIGINT) ELSE kept END
  FROM walk WHERE place < len(words)""")
part("cleaned", "walk", """
  SELECT topic, unnest(list_transform(kept, lambda i: words[i])) AS word,
         generate_subscripts(kept, 1) AS rank
  FROM walk WHERE place = len(words)""")

# --- topic quality -------------------------------------------------------------------------------

part("sizes", "", f"SELECT unnest({LIST_SIZES})::INTEGER AS t")
part("words", "seeds", "SELECT DISTINCT word FROM seeds")
part("pairs", "seeds", """
  SELECT a.topic, a.rank AS i, b.rank AS j, a.word AS word_i, b.word AS word_j
  FROM seeds a JOIN seeds b ON a.topic = b.topic AND a.rank < b.rank""")
part("grid", "sizes seeds", "SELECT DISTINCT t, topic FROM sizes CROSS JOIN seeds")
for _name, _cells in (("meta", "x"), ("word", "plain")):
    part(f"{_name}_found", f"{_cells} words", f"""
  SELECT DISTINCT doc_id, word FROM {_cells} WHERE value <> 0 AND word IN (SELECT word FROM words)""")
    part(f"{_name}_cw", f"{_cells} words", f"""
  SELECT w.word, count(x.word) AS c_w FROM words w LEFT JOIN {_cells} x ON x.word = w.word GROUP BY w.word""")
    part(f"{_name}_co", f"{_name}_found pairs", f"""
  SELECT word_i, word_j, count(*) AS c
  FROM (SELECT DISTINCT word_i, word_j FROM pairs) p
  JOIN {_name}_found a ON a.word = word_i JOIN {_name}_found b ON b.word = word_j AND a.doc_id = b.doc_id
  GROUP BY ALL""")
    part(f"{_name}_pairs", f"pairs {_name}_co {_name}_cw", f"""
  SELECT p.*, coalesce(c, 0) AS c_ij, ci.c_w AS c_i, cj.c_w AS c_j
  FROM pairs p LEFT JOIN {_name}_co USING (word_i, word_j)
  JOIN {_name}_cw ci ON ci.word = word_i JOIN {_name}_cw cj ON cj.word = word_j""")
    part(f"{_name}_size", _cells, f"SELECT count(*)::DOUBLE AS n FROM {_cells}")
    part(f"{_name}_docs", _cells, f"SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM {_cells}")
    part(f"{_name}_coherence", f"grid {_name}_pairs", f"""
  SELECT g.t, g.topic, coalesce(sum(ln((c_ij + 1) / c_i)) FILTER (c_i > 0), 0) AS coherence,
         count(*) FILTER (c_i = 0) AS n_missing
  FROM grid g LEFT JOIN {_name}_pairs p ON p.topic = g.topic AND p.j <= g.t GROUP BY g.t, g.topic""")
    for _universe in ("size", "docs"):
        part(f"{_name}_pmi_{_universe}", f"grid {_name}_pairs {_name}_{_universe}", f"""
  SELECT t, topic, s / (t * (t - 1)) AS pmi, s / w AS npmi, n_missing FROM (
    SELECT g.t, g.topic,
           coalesce(sum(ln(((c_ij + 1) / n) / ((c_i::DOUBLE * c_j) / (n * n)))) FILTER (c_i > 0 AND c_j > 0), 0) AS s,
           sum(-ln((c_ij + 0.01) / n)) FILTER (c_i > 0 AND c_j > 0) AS w,
           count(*) FILTER (c_i = 0 OR c_j = 0) AS n_missing
    FROM grid g LEFT JOIN {_name}_pairs p ON p.topic = g.topic AND p.j <= g.t CROSS JOIN {_name}_{_universe}
    GROUP BY g.t, g.topic)""")
part("distances", "grid pairs vec", """
  SELECT g.t, g.topic,
         sum(sqrt(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2)) / (g.t * (g.t - 1)) AS l1,
         sum(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2) / (g.t * (g.t - 1)) AS l2,
         sum(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) / (g.t * (g.t - 1)) AS cosine
  FROM grid g JOIN pairs p ON p.topic = g.topic AND p.j <= g.t
  JOIN vec a ON a.word = word_i JOIN vec b ON b.word = word_j GROUP BY g.t, g.topic""")


def summary(source: str, column: str, metric: str, where: str = "true") -> str:
    return (
        f"SELECT t, '{metric}' AS metric, round(avg({column}), 4) AS mean,"
        f" round(stddev_pop({column}), 4) AS std FROM {source} WHERE {where} GROUP BY t"
    )


# --- entities ------------------------------------------------------------------------------------

part("lifted", "dt", """
  SELECT doc_id, topic, weight - min(weight) OVER (PARTITION BY doc_id) AS x,
         max(weight) OVER (PARTITION BY doc_id) > min(weight) OVER (PARTITION BY doc_id) AS varied
  FROM dt""")
part("pct", "lifted", """
  SELECT doc_id, topic, round_even(x / sum(x) OVER (PARTITION BY doc_id) * 100, 2) AS pct
  FROM lifted WHERE varied""")
part("valid", "pct", "SELECT doc_id, sum(pct) AS sum, max(pct) AS best FROM pct GROUP BY doc_id HAVING sum(pct) > 0")
part("focused", "pct valid", """
  SELECT pct.*, source, lang FROM pct JOIN valid USING (doc_id) JOIN documents USING (doc_id) WHERE best >= 10""")
part("links", "", """
  SELECT doc_id AS paper_id, 'a' || (n_chars % 97) AS author_id, source AS work_institution, lang AS uf_id
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""")
part("shares", "links dt", """
  SELECT l.*, topic,
         CASE WHEN max(weight) OVER (PARTITION BY paper_id) > 0
              THEN weight / sum(weight) OVER (PARTITION BY paper_id) * 100
              WHEN topic = 0 THEN 100.0 ELSE 0.0 END AS pct
  FROM links l JOIN dt ON dt.doc_id = paper_id""")


def entity_parts(suffix: str, column: str) -> None:
    part(f"totals_{suffix}", "shares", f"""
  SELECT {column} AS entity, topic, sum(pct) AS total FROM shares WHERE pct > 0 GROUP BY ALL""")
    part(f"col_{suffix}", f"totals_{suffix}", f"""
  SELECT *, total / sum(total) OVER (PARTITION BY entity) * 100 AS row_pct,
         total / sum(total) OVER (PARTITION BY topic) * 100 AS col_pct FROM totals_{suffix}""")
    part(f"place_{suffix}", f"col_{suffix}", f"""
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY col_pct DESC, entity) <= 10 AS best FROM col_{suffix}""")
    part(f"top_{suffix}", f"place_{suffix}", f"""
  SELECT *, CASE WHEN best THEN col_pct / sum(col_pct) FILTER (best) OVER (PARTITION BY topic) * 100
                 ELSE 0.0 END AS top_pct FROM place_{suffix}""")
    part(f"profile_{suffix}", f"top_{suffix} topic_ids", f"""
  SELECT entity, topic, round(coalesce(row_pct, 0.0), 4) AS row_pct, round(coalesce(top_pct, 0.0), 4) AS top_pct
  FROM (SELECT DISTINCT entity FROM top_{suffix}) CROSS JOIN topic_ids LEFT JOIN top_{suffix} USING (entity, topic)""")


entity_parts("author", "author_id")
entity_parts("institution", "work_institution")
entity_parts("uf", "uf_id")

# --- acronyms ------------------------------------------------------------------------------------

ACRONYM_TOKENS = r"[\p{L}\p{N}_]+(?:[-''][\p{L}\p{N}_]+)*|[^\s]"
part("part_texts", "", """
  SELECT p_partkey AS doc_id, lower(words || ' (' || initials || ')') AS text, p_size, p_brand
  FROM (SELECT *, array_to_string(list_transform(string_split(words, ' '), lambda x: left(x, 1)), '') AS initials
        FROM (SELECT *, p_type || ' ' || p_name AS words FROM part))""")
part("marked", "", f"""
  SELECT doc_id, text, w FROM (
    SELECT doc_id, text, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]{{4,}}'),
                                     lambda x: NOT list_contains([{quoted(STOPWORDS)}], x)) AS w FROM documents)
  WHERE len(w) >= 3""")
part("marked_texts", "marked", """
  SELECT doc_id, w[1] || '-' || w[2] || ' ' || w[3] || ' (' || left(w[1], 1) || left(w[2], 1) || left(w[3], 1) || ') ' || text AS text
  FROM marked""")
for _name, _source in (("part_hits", "part_texts"), ("doc_hits", "marked_texts")):
    part(_name, _source, f"""
  SELECT doc_id, i - 1 AS pos, toks[i + 1] AS acronym, toks FROM (
    SELECT doc_id, toks, unnest(range(1, len(toks) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '{ACRONYM_TOKENS}') AS toks FROM {_source}))
  WHERE toks[i] = '(' AND toks[i + 2] = ')' AND length(toks[i + 1]) BETWEEN 2 AND 4
    AND NOT regexp_full_match(toks[i + 1], '\\p{{Nd}}+')""")
# none of these texts has a hyphen, so the words are the tokens before the parenthesis
part("before", "part_hits", """
  SELECT doc_id, pos, acronym,
         list_slice(toks, greatest(pos - length(acronym) + 1, 1), pos) AS words FROM part_hits""")
part("expanded", "before", f"""
  SELECT doc_id, pos, acronym,
         array_to_string(list_filter(words, lambda x: NOT list_contains([{quoted(STOPWORDS)}], x)), '_') AS meaning
  FROM before""")
part("dictionary", "expanded", """
  SELECT acronym, arg_max(meaning, doc_id * 1000 + pos) AS meaning FROM expanded WHERE meaning <> '' GROUP BY acronym""")
part("acronym_lists", "part_hits part_texts", """
  SELECT topic, word, rank FROM (
    SELECT topic, word, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, word) AS rank
    FROM (SELECT p_size % 5 AS topic, unnest([acronym, p_brand]) AS word
          FROM part_hits JOIN part_texts USING (doc_id)) GROUP BY topic, word) WHERE rank <= 30""")
part("rewritten", "acronym_lists dictionary", """
  SELECT topic, rank, coalesce(meaning, word) AS word
  FROM acronym_lists LEFT JOIN dictionary ON acronym = word""")

# --- factorisation -------------------------------------------------------------------------------

part("h0", "vec", """
  SELECT word, CASE WHEN label % 3 = 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS h0,
         CASE WHEN label % 3 = 1 THEN 1.0 ELSE 0.1 END::DOUBLE AS h1,
         CASE WHEN label % 3 = 2 THEN 1.0 ELSE 0.1 END::DOUBLE AS h2 FROM vec""")


def half_sweep(name: str, key: str, x_key: str, fixed: str, start: str, f: str, m: str) -> None:
    """One pass over three coordinates of ``m`` with factor ``f`` fixed: alpha .1, l1_ratio .5."""
    part(f"{name}_g", fixed, "SELECT " + ", ".join(
        f"sum({f}{i} * {f}{j}){' + 0.05' if i == j else ''} AS g{i}{j}" for i in range(3) for j in range(3)
    ) + f" FROM {fixed}")
    part(f"{name}_b", f"x {fixed}", f"SELECT x.{key}, " + ", ".join(
        f"sum(value * {f}{j}) AS b{j}" for j in range(3)
    ) + f" FROM x JOIN {fixed} USING ({x_key}) GROUP BY x.{key}")
    needs, source = f"{name}_g {name}_b {start}", (
        f"(SELECT s.*, g.*, coalesce(b0, 0) - 0.05 AS b0, coalesce(b1, 0) - 0.05 AS b1,"
        f" coalesce(b2, 0) - 0.05 AS b2 FROM {start} s LEFT JOIN {name}_b USING ({key}) CROSS JOIN {name}_g g)"
    )
    for t in range(3):
        slope = " + ".join(f"g{t}{j} * {m}{j}" for j in range(3))
        step = f"greatest(0, {m}{t} - ({slope} - b{t}) / g{t}{t}) AS {m}{t}"
        last = name if t == 2 else f"{name}_{t}"
        part(last, needs, f"SELECT * REPLACE ({step}) FROM {source}")
        needs, source = last, last


part("w0", "", """
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.1 END::DOUBLE AS w0,
         CASE WHEN doc_id % 3 = 1 THEN 1.0 ELSE 0.1 END::DOUBLE AS w1,
         CASE WHEN doc_id % 3 = 2 THEN 1.0 ELSE 0.1 END::DOUBLE AS w2 FROM documents""")
part("wz", "x", "SELECT DISTINCT doc_id, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w2 FROM x")
half_sweep("w1", "doc_id", "word", "h0", "w0", "h", "w")
half_sweep("wt", "doc_id", "word", "h0", "wz", "h", "w")
part("w1x", "w1", "SELECT doc_id, w0, w1, w2 FROM w1")
half_sweep("h1", "word", "doc_id", "w1x", "h0", "w", "h")


# --- latent Dirichlet allocation -----------------------------------------------------------------


def digamma(x: str) -> str:
    """Recurrence to x + 10, then the asymptotic series."""
    steps = " + ".join(f"1 / ({x} + {i})" for i in range(10))
    y = f"({x} + 10)"
    series = f"ln({y}) - 1 / (2 * {y}) - 1 / (12 * {y} ** 2) + 1 / (120 * {y} ** 4) - 1 / (252 * {y} ** 6) + 1 / (240 * {y} ** 8)"
    return f"({series} - ({steps}))"


part("cnt", "tf df", """
  SELECT doc_id, word, tf.n::DOUBLE AS c FROM tf JOIN df USING (word)
  WHERE df >= 2 AND df <= 0.95::DOUBLE * (SELECT count(*) FROM documents)""")
part("l0", "cnt", """
  SELECT word, topic, (1 + (length(word) + topic) % 3)::DOUBLE AS f
  FROM (SELECT DISTINCT word FROM cnt) CROSS JOIN (SELECT unnest(range(3)) AS topic)""")
part("lbeta", "l0", f"""
  SELECT word, topic, f, exp({digamma('f')} - {digamma('s')}) AS beta
  FROM (SELECT *, sum(f) OVER (PARTITION BY topic) AS s FROM l0)""")
# from equal weights every topic has the same factor t0, which leaves the first step's ratio
part("lgamma", "cnt lbeta", """
  SELECT doc_id, topic, 1 / 3::DOUBLE + sum(c * beta / s) AS g
  FROM (SELECT doc_id, word, topic, c, beta, sum(beta) OVER (PARTITION BY doc_id, word) AS s
        FROM cnt JOIN lbeta USING (word)) GROUP BY ALL""")
part("ltheta", "lgamma", f"""
  SELECT doc_id, topic, exp({digamma('g')} - {digamma('s')}) AS theta
  FROM (SELECT *, sum(g) OVER (PARTITION BY doc_id) AS s FROM lgamma)""")
part("lsum", "cnt lbeta ltheta", """
  SELECT word, topic, sum(c * theta * beta / s) AS added
  FROM (SELECT word, topic, c, theta, beta, sum(theta * beta) OVER (PARTITION BY doc_id, word) AS s
        FROM cnt JOIN lbeta USING (word) JOIN ltheta USING (doc_id, topic)) GROUP BY ALL""")
part("lnew", "l0 lsum", """
  SELECT topic, word, (1 - 51 ** -0.7::DOUBLE) * f + 51 ** -0.7::DOUBLE * (1 / 3::DOUBLE + added) AS weight
  FROM l0 JOIN lsum USING (word, topic)""")


def factor_rows(table: str, key: str, m: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {key}, {j} AS topic, round({m}{j}, 4) AS weight FROM {table}" for j in range(3)
    )


# --- statements ----------------------------------------------------------------------------------


def statements() -> dict[str, str]:
    missing = quoted(MISSING_TEXTS)
    csv_text = f"CASE WHEN text IN ({missing}) THEN '' ELSE text END AS text"
    sub_grams = " , ".join(
        f"CASE WHEN length(m) >= {n} THEN list_transform(range(1, length(m) - {n} + 2), lambda i: substring(m, i, {n}))"
        " ELSE [] END"
        for n in range(3, 7)
    )

    # words at distances 1 to 10, weighted 10 to 1, in both directions
    near = """
        , often AS (SELECT word FROM runs GROUP BY word HAVING count(*) >= 5)
        , pairs AS (SELECT a.word AS w1, b.word AS w2, 11 - d AS n
                    FROM runs a CROSS JOIN (SELECT unnest(range(1, 11)) AS d) JOIN runs b ON b.doc_id = a.doc_id AND b.pos = a.pos + d
                    WHERE a.word IN (FROM often) AND b.word IN (FROM often))
        , near AS (SELECT word, context, sum(n)::BIGINT AS n
                   FROM (SELECT w1 AS word, w2 AS context, n FROM pairs UNION ALL SELECT w2, w1, n FROM pairs) GROUP BY ALL)"""

    def grams(source: str) -> str:
        return (
            f"SELECT word, unnest(list_distinct(flatten([{sub_grams}]))) AS ngram"
            f" FROM (SELECT DISTINCT word, '<' || word || '>' AS m FROM {source})"
        )

    report = " UNION ALL ".join(
        f"SELECT {t} AS t, 0 AS line, 'Topics {N_SEEDS} N_Words {t} - seeds' AS value"
        f" UNION ALL SELECT {t}, 1, 'Topics:'"
        f" UNION ALL SELECT {t}, topic + 2, coalesce(string_agg(word || ' ', '' ORDER BY rank), '')"
        f" FROM topic_ids LEFT JOIN seeds USING (topic) WHERE rank <= {t} OR rank IS NULL GROUP BY topic"
        for t in LIST_SIZES
    )
    wide = ", ".join(
        f'round_even(max(weight) FILTER (topic = {j}), 4) AS "Topico {j}"' for j in range(N_SEEDS)
    )
    dominant = (
        "SELECT doc_id, min(topic) FILTER (weight = best)::INTEGER AS dominant_topic FROM"
        " (SELECT *, max(weight) OVER (PARTITION BY doc_id) AS best FROM dt) GROUP BY doc_id"
    )

    def ranks(entity: str) -> str:
        return f"SELECT {entity} AS entity, topic, sum(pct) AS total FROM focused WHERE {entity} IS NOT NULL GROUP BY ALL"

    def entity_pct(entity: str) -> str:
        return (
            f"SELECT '{entity}' AS kind, entity, topic,"
            f" round(total / sum(total) OVER (PARTITION BY entity) * 100, 3) AS pct FROM ({ranks(entity)})"
        )

    def profiles(kind: str, suffix: str) -> str:
        return f"SELECT '{kind}' AS kind, entity, topic, row_pct, top_pct FROM profile_{suffix}"

    def pmi(name: str, universe: str = "size") -> str:
        return (
            f"SELECT t, topic, round(pmi, 4) AS pmi, round(npmi, 4) AS npmi, n_missing"
            f" FROM {name}_pmi_{universe}"
        )

    return {
        "corpus_table": "SELECT doc_id, text, source, lang FROM documents",
        "corpus_csv": f"SELECT doc_id::VARCHAR AS doc_id, {csv_text}, source, lang FROM documents",
        "corpus_csv_row_ids": f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS doc_id, {csv_text}, lang FROM documents",
        "corpus_lines": """SELECT row_number() OVER (ORDER BY doc_id, pos) - 1 AS doc_id,
            regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS text
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                         generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)""",
        "title_abstract": """SELECT doc_id, CASE WHEN lang <> 'en' THEN source ELSE '' END || '. ' ||
            CASE WHEN source <> 'src0' THEN text ELSE '' END AS text FROM documents""",
        "word_vectors_text": """SELECT 'v' || vec_id AS word, generate_subscripts(embedding, 1) - 1 AS pos,
            round(unnest(embedding)::DOUBLE, 6) AS x FROM embeddings""",
        "model_round_trip": statement("x", "SELECT doc_id, word, round(value, 4) AS value FROM x"),
        "topic_report": statement("topic_ids seeds", report),
        "topic_report_read": statement("seeds", "SELECT topic, rank, word FROM seeds WHERE rank <= 10"),
        "topic_report_table": statement("seeds sizes", "SELECT t, topic, rank, word FROM seeds CROSS JOIN sizes WHERE rank <= t"),
        "doc_topics_wide": statement("dt", f"""SELECT {wide}, doc_id AS id, max(dominant_topic) AS dominant_topic
            FROM dt JOIN ({dominant}) USING (doc_id) GROUP BY doc_id"""),
        "doc_topics_summary": statement("dt", f"SELECT doc_id AS papers, dominant_topic FROM ({dominant})"),
        "entity_tables_written": statement("focused", entity_pct("source") + " UNION ALL " + entity_pct("lang")),
        "known_links": statement("links", "SELECT * FROM links"),
        "tokens_space": statement("space", "SELECT doc_id, pos, word FROM space"),
        "tokens_word": statement("runs", "SELECT doc_id, pos, word FROM runs"),
        "vocabulary": statement("space", "SELECT word, row_number() OVER (ORDER BY word) - 1 AS term_id FROM (SELECT DISTINCT word FROM space)"),
        "term_frequency": statement("tf", "SELECT * FROM tf"),
        "term_frequency_fixed_vocabulary": statement("vtf", "SELECT * FROM vtf"),
        "document_frequency": statement("df", "SELECT * FROM df"),
        "tf_bounded": statement("tf df n", """SELECT doc_id, word, tf.n FROM tf JOIN df USING (word) CROSS JOIN n
            WHERE df >= 2 AND df <= 0.95::DOUBLE * n.n"""),
        "tf_idf": statement("plain", "SELECT doc_id, word, round(value, 6) AS value FROM plain"),
        "embedding_vocab": statement("vec", "SELECT word, label FROM vec"),
        "vocab_coverage": statement("vec runs", """SELECT *, round(n_words / total_words, 2) AS coverage FROM
            (SELECT (SELECT count(*) FROM vec) AS n_words, (SELECT count(DISTINCT word) FROM runs) AS total_words)"""),
        "prepared_vectors": statement("unit", "SELECT word, generate_subscripts(u, 1) - 1 AS pos, round(unnest(u), 7) AS x FROM unit"),
        "knn_cosine": statement("near", "SELECT metaword, term, round(sim, 7) AS sim, rank FROM near"),
        "threshold_neighbours": statement("nb", "SELECT * FROM nb"),
        "neighbours_without_threshold": statement("near", "SELECT metaword, term, round(sim, 2) AS sim FROM near WHERE round(sim, 2) <> 0"),
        "metaword_tf": statement("c", "SELECT doc_id, metaword, round(ctf, 4) AS ctf FROM c"),
        "metaword_mean_sim": statement("c", "SELECT doc_id, metaword, round(ctf / npos, 9) AS mu FROM c"),
        "metaword_idf": statement("idf", "SELECT metaword, round(idf, 6) AS idf FROM idf"),
        "metaword_tfidf": statement("x", "SELECT doc_id, word AS metaword, round(value, 4) AS value FROM x"),
        "metaword_tfidf_defaults": statement("x_default", "SELECT doc_id, word AS metaword, round(value, 4) AS value FROM x_default"),
        "metaword_tfidf_word_tokens": statement("x_runs", "SELECT doc_id, word AS metaword, round(value, 4) AS value FROM x_runs"),
        "subword_vectors": statement("vec runs", f"""
            , known AS (SELECT g.ngram, p, avg(v.embedding[p]::DOUBLE) AS x
                        FROM ({grams('vec')}) g JOIN vec v USING (word) CROSS JOIN (SELECT unnest(range(1, 65)) AS p)
                        GROUP BY ALL),
              gram_vectors AS (SELECT ngram, list(x ORDER BY p) AS v FROM known GROUP BY ngram),
              means AS (SELECT word, p, avg(v[p]) AS x
                        FROM ({grams('runs')}) JOIN gram_vectors USING (ngram) CROSS JOIN (SELECT unnest(range(1, 65)) AS p)
                        GROUP BY ALL)
            SELECT word, round(sum(x), 5) AS total, round(max(x) FILTER (p = 1), 6) AS first,
                   round(max(x) FILTER (p = 64), 6) AS last FROM means GROUP BY word"""),
        "word2vec_words": """SELECT word, 100 AS n_values, TRUE AS finite
            FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents) GROUP BY word HAVING count(*) >= 5""",
        "context_counts": statement("runs", near + " SELECT word, context, n FROM near"),
        "shifted_pmi": statement("runs", near + """
            , smooth AS (SELECT context, sum(n) ** 0.75 AS p FROM near GROUP BY context)
            , scored AS (SELECT word, context,
                                ln(n / sum(n) OVER (PARTITION BY word) / (p / (SELECT sum(p) FROM smooth))) - ln(5.0::DOUBLE) AS value
                         FROM near JOIN smooth USING (context))
            SELECT word, context, round(value, 6) AS value FROM scored WHERE value > 0"""),
        "nmf_sweep_documents": statement("w1", factor_rows("w1", "doc_id", "w")),
        "nmf_sweep_words": statement("h1", factor_rows("h1", "word", "h")),
        "nmf_tiled_sweep_documents": statement("w1", factor_rows("w1", "doc_id", "w")),
        "nmf_tiled_sweep_words": statement("h1", factor_rows("h1", "word", "h")),
        "nmf_transform": statement("wt", factor_rows("wt", "doc_id", "w")),
        "lda_update": statement("lnew", "SELECT topic::INTEGER AS topic, word, round(weight, 6) AS weight FROM lnew"),
        "lda_doc_topics_total": "SELECT doc_id, 1.0::DOUBLE AS total FROM documents",
        "lda_topic_word_size": statement("cnt", "SELECT word, 10 AS n_topics FROM cnt GROUP BY word"),
        "top_words": statement("ranked", "SELECT topic, rank, word, weight FROM ranked WHERE rank <= 101"),
        "drop_short_words": statement("df", """SELECT 0 AS topic, row_number() OVER (ORDER BY rank) AS rank, word
            FROM (SELECT word, row_number() OVER (ORDER BY df DESC, word) AS rank FROM df)
            WHERE rank <= 2000 AND length(word) > 1"""),
        "drop_short_words_all": statement("df", """SELECT 0 AS topic, row_number() OVER (ORDER BY df DESC, word)::INTEGER AS rank, word
            FROM df WHERE length(word) > 1"""),
        "nmf_documents_optimal": statement("x", "SELECT DISTINCT doc_id, true AS optimal FROM x"),
        "nmf_words_optimal": statement("x", "SELECT DISTINCT word, true AS optimal FROM x"),
        "similar_word_pairs": statement("plain_words", f"""SELECT a.topic, a.rank AS rank_a, b.rank AS rank_b,
            a.word AS word_a, b.word AS word_b, round({winkler('a.s', 'b.s')}, 6) AS similarity
            FROM plain_words a JOIN plain_words b ON a.topic = b.topic AND a.rank < b.rank"""),
        "dedupe_similar_words": statement("cleaned", "SELECT topic, rank, word FROM cleaned", True),
        "head_words": statement("cleaned", "SELECT topic, rank, word FROM cleaned WHERE rank <= 10", True),
        "round_doc_topics": statement("dt", "SELECT doc_id, topic, round_even(weight, 3) AS weight FROM dt"),
        "dominant_topic": statement("dt", dominant),
        "dominant_topic_counts": statement("dt", f"SELECT dominant_topic, count(*) AS n_docs FROM ({dominant}) GROUP BY dominant_topic"),
        "word_occurrence": statement("meta_cw", "SELECT word, c_w FROM meta_cw"),
        "word_occurrence_plain": statement("word_cw", "SELECT word, c_w FROM word_cw"),
        "universe_size": statement("x plain", """SELECT 'metaword' AS cells_of, count(*) AS n_cells, count(DISTINCT doc_id) AS n_docs FROM x
            UNION ALL SELECT 'word', count(*), count(DISTINCT doc_id) FROM plain"""),
        "pair_cooccurrence": statement("meta_pairs", "SELECT topic, i, j, word_i, word_j, c_ij FROM meta_pairs"),
        "coherence": statement("meta_coherence", "SELECT t, topic, round(coherence, 4) AS coherence, n_missing FROM meta_coherence"),
        "pmi_npmi": statement("word_pmi_size", pmi("word")),
        "pmi_npmi_document_universe": statement("word_pmi_docs", pmi("word", "docs")),
        "metaword_npmi": statement("meta_pmi_size", pmi("meta")),
        "embedding_distance": statement("distances", " UNION ALL ".join(
            f"SELECT '{kind}' AS kind, t, topic, round({column}, 4) AS distance FROM distances"
            for kind, column in (("l1_dist", "l1"), ("l2_dist", "l2"), ("cos_dist", "cosine"), ("coord_dist", "l2")))),
        "summarise_metric": statement("meta_coherence", summary("meta_coherence", "coherence", "coherence")),
        "calc_metrics": statement("meta_coherence meta_pmi_size word_pmi_size distances", " UNION ALL ".join([
            summary("meta_coherence", "coherence", "coherence"),
            summary("meta_pmi_size", "npmi", "metaword_npmi"),
            summary("word_pmi_size", "npmi", "npmi"),
            summary("distances", "l1", "w2v_l1")])),
        "metrics_table": statement("word_coherence word_pmi_size", " UNION ALL ".join([
            summary("word_pmi_size", "npmi", "npmi"),
            summary("word_coherence", "coherence", "coherence")])),
        "calc_metrics_from_list": statement("word_coherence word_pmi_size", " UNION ALL ".join([
            summary("word_coherence", "coherence", "coherence", "t = 10"),
            summary("word_pmi_size", "npmi", "npmi", "t = 10")])),
        "minmax_percent": statement("pct", "SELECT doc_id, topic, pct FROM pct"),
        "valid_doc_topics": statement("valid", "SELECT doc_id, round(sum, 2) AS sum FROM valid"),
        "join_doc_attributes": statement("valid", "SELECT doc_id, source, lang, best FROM valid JOIN documents USING (doc_id)"),
        "focused_docs": statement("valid", "SELECT doc_id FROM valid WHERE best >= 40"),
        "entity_topic_sum": statement("focused", f"SELECT entity AS source, topic, round(total, 2) AS total FROM ({ranks('source')})"),
        "entity_row_percent": statement("focused", f"SELECT entity AS lang, 100.0::DOUBLE AS sum, topic, pct FROM ({entity_pct('lang')})"),
        "link_doc_topics": statement("links dt", "SELECT l.*, topic, round(weight, 4) AS weight FROM links l JOIN dt ON dt.doc_id = paper_id"),
        "percent_or_first": statement("shares", "SELECT paper_id, topic, round(pct, 4) AS pct FROM shares"),
        "positive_topics_map": statement("shares", "SELECT paper_id, author_id, topic, round(pct, 4) AS pct FROM shares WHERE pct > 0"),
        "entity_topic_total": statement("totals_author", "SELECT entity, topic, round(total, 4) AS total FROM totals_author"),
        "row_percent": statement("col_author", "SELECT entity, topic, round(total, 4) AS total, round(row_pct, 4) AS row_pct FROM col_author"),
        "column_percent": statement("col_author", "SELECT entity, topic, round(total, 4) AS total, round(col_pct, 4) AS col_pct FROM col_author"),
        "top10_share_per_topic": statement("top_author", "SELECT entity, topic, round(col_pct, 4) AS col_pct, round(top_pct, 4) AS top_pct FROM top_author"),
        "entity_topic_table": statement("profile_institution", "SELECT entity, topic, row_pct, top_pct FROM profile_institution"),
        "normalize_entities": statement("profile_author profile_institution profile_uf", " UNION ALL ".join([
            profiles("normalized_topics_authors", "author"),
            profiles("normalized_topics_institutions", "institution"),
            profiles("normalized_topics_uf", "uf")])),
        "tokens_acronym": f"""SELECT doc_id, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos
            FROM (SELECT doc_id, regexp_extract_all(lower(text), '{ACRONYM_TOKENS}') AS toks FROM documents)""",
        "find_acronyms": statement("before", "SELECT doc_id, pos, acronym, array_to_string(list_reverse(words), ' ') AS before FROM before"),
        "find_acronyms_documents": statement("doc_hits", "SELECT doc_id, pos, acronym FROM doc_hits"),
        "expand_hyphenated": statement("marked", """SELECT doc_id, left(w[1], 1) || left(w[2], 1) || left(w[3], 1) AS acronym,
            w[1] || '_' || w[2] || '_' || w[3] AS meaning FROM marked"""),
        "load_punctuation": r"SELECT DISTINCT unnest(regexp_extract_all(text, '[^\p{L}\p{N}\s]')) AS mark FROM documents",
        "title_abstract_file": """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang <> 'en' THEN source ELSE '' END || '. ' ||
            CASE WHEN source <> 'src0' THEN text ELSE '' END AS text FROM documents""",
        "corpus_csv_by_lines": f"""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN t IN ({missing}) THEN '' ELSE t END AS text
            FROM (SELECT doc_id, replace(text, chr(10), ' ') AS t FROM documents)""",
        "corpus_table_row_ids": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, text, lang FROM documents",
        "word_vectors_number_words": "SELECT vec_id::VARCHAR AS word, label AS x FROM embeddings",
        "topic_report_brackets": statement("seeds", """SELECT topic, rank, CASE WHEN rank = 1 THEN '[1]' ELSE '' END || word AS word
            FROM seeds WHERE rank <= 5"""),
        "known_links_file": statement("links", "SELECT * REPLACE (paper_id::VARCHAR AS paper_id) FROM links"),
        "calc_metrics_from_strings": statement("word_coherence word_pmi_size", " UNION ALL ".join([
            summary("word_coherence", "coherence", "coherence", "t = 5"),
            summary("word_pmi_size", "npmi", "npmi", "t = 5")])),
        "expand_acronym": statement("expanded", "SELECT doc_id, pos, acronym, meaning FROM expanded WHERE meaning <> ''"),
        "acronym_dictionary": statement("dictionary", "SELECT acronym, meaning FROM dictionary"),
        "dictionary_lines": statement("expanded", "SELECT doc_id, pos, meaning || '>>>>>' || acronym AS value FROM expanded WHERE meaning <> ''"),
        "rewrite_topics": statement("rewritten", "SELECT topic, rank, word FROM rewritten"),
        "acronym_topics": statement("rewritten", "SELECT topic, rank, word FROM rewritten WHERE rank <= 10"),
    }
