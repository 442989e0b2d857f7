"""Reference SQL for the registered queries, in the dialect of DuckDB.

Each statement is written from the meaning of the query and runs over whole tables. Views
repeat the definitions of :mod:`molspark.catalog.views`.
"""

from __future__ import annotations

from molspark.catalog.views import ENDINGS, EXAMPLES, REGISTRY
from molspark.functions import smiles as S

# View name to (views it needs, definition).
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    _VIEWS[name] = (needs, body)


def _with(sql: str, *names: str) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for need in _VIEWS[name][0]:
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_VIEWS[n][1]})" for n in ordered) + "\n" + sql


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ALKENE = "'C=C' || repeat('C', greatest(p_size - 2, 0))"

_view(
    "molecules",
    f"""SELECT p_partkey AS mol_id,
       CASE WHEN p_partkey % 2 = 0 THEN 'alkene' ELSE 'alcohol' END AS family,
       p_size::INT AS carbons,
       CASE WHEN p_partkey % 2 = 0 THEN {_ALKENE}
            ELSE repeat('C', greatest(p_size - 1, 1)) || 'O' END AS smiles,
       p_retailprice AS label, p_brand AS source
FROM part""",
)
_view(
    "examples",
    "SELECT * FROM (VALUES "
    + ", ".join(f"({i}, {_quoted(s)}, {_quoted(e)})" for i, (s, e) in enumerate(EXAMPLES))
    + ") AS t(id, smiles, expect)",
)
_view(
    "mixed",
    f"""SELECT p_partkey AS mol_id, smiles, expect, p_brand AS source
FROM part JOIN examples ON p_partkey % {len(EXAMPLES)} = id""",
    ("examples",),
)
# The atoms of the examples that can be read, written by hand: symbols, aromatic atoms
# counted from the first, charges, bonds, sums of orders in the Kekulé form, hydrogens, fragments.
_EXAMPLE_ATOMS = [
    ("CCO", "C C O", 0, "0 0 0", "1 2 1", "1 2 1", "3 2 1", "0 0 0"),
    ("C=CC", "C C C", 0, "0 0 0", "1 2 1", "2 3 1", "2 1 3", "0 0 0"),
    ("C1CCCCC1", "C C C C C C", 0, "0 0 0 0 0 0", "2 2 2 2 2 2", "2 2 2 2 2 2", "2 2 2 2 2 2", "0 0 0 0 0 0"),
    ("c1ccccc1", "C C C C C C", 6, "0 0 0 0 0 0", "2 2 2 2 2 2", "3 3 3 3 3 3", "1 1 1 1 1 1", "0 0 0 0 0 0"),
    ("C[C@@H](N)C(=O)[O-]", "C C N C O O", 0, "0 0 0 0 0 -1", "1 3 1 3 1 1", "1 3 1 4 2 1", "3 1 2 0 0 0", "0 0 0 0 0 0"),
    ("[13CH4]", "C", 0, "0", "0", "0", "4", "0"),
    ("ClCCBr", "Cl C C Br", 0, "0 0 0 0", "1 2 2 1", "1 2 2 1", "0 2 2 0", "0 0 0 0"),
    ("C%12CCCCC%12", "C C C C C C", 0, "0 0 0 0 0 0", "2 2 2 2 2 2", "2 2 2 2 2 2", "2 2 2 2 2 2", "0 0 0 0 0 0"),
    ("[Na+].[Cl-]", "Na Cl", 0, "1 -1", "0 0", "0 0", "0 0", "0 1"),
]
# Caffeine, the same way, with the places of its aromatic atoms.
_CAFFEINE = (
    "Cn1cnc2c1c(=O)n(C)c(=O)n2C", "C N C N C C C O N C C O N C", (1, 2, 3, 4, 5, 6, 8, 10, 12), "1 3 2 2 3 3 3 1 3 1 3 1 3 1",
    "1 3 3 3 4 4 4 2 3 1 4 2 3 1", "3 0 1 0 0 0 0 0 0 3 0 0 0 3",
)


def _example_atoms() -> str:
    rows = []
    for smiles, symbols, aromatic, *numbers in _EXAMPLE_ATOMS:
        for i, (symbol, *values) in enumerate(zip(symbols.split(), *(x.split() for x in numbers), strict=True)):
            rows.append((smiles, i, symbol, i < aromatic, *map(int, values)))
    smiles, symbols, aromatic, *numbers = _CAFFEINE
    for i, (symbol, *values) in enumerate(zip(symbols.split(), *(x.split() for x in numbers), strict=True)):
        rows.append((smiles, i, symbol, i in aromatic, 0, *map(int, values), 0))
    return ", ".join(f"({_quoted(r[0])}, {r[1]}, {_quoted(r[2])}, {', '.join(map(str, r[3:]))})" for r in rows)


_view(
    "example_atoms",
    f"SELECT * FROM (VALUES {_example_atoms()}) AS t(smiles, atom, symbol, aromatic, charge, degree, orders, hydrogens, fragment)",
)
_view(
    "ended",
    f"""SELECT mol_id, family, carbons, source, (mol_id % {len(ENDINGS)})::INT AS ending,
       smiles || ([{", ".join(map(_quoted, ENDINGS))}])[mol_id % {len(ENDINGS)} + 1] AS smiles,
       CASE WHEN family = 'alkene' THEN greatest(carbons, 2) ELSE greatest(carbons - 1, 1) END AS c,
       (family = 'alcohol')::INT AS o,
       CASE WHEN family = 'alkene' THEN 4 ELSE 2 END - CASE WHEN family = 'alkene' AND carbons <= 2 THEN 2 ELSE 1 END AS free
FROM molecules""",
    ("molecules",),
)
# what an ending adds: bonds to the chain, carbon, hydrogen, oxygen, fluorine, sodium, bonds and rings of its own, charge
_view(
    "endings",
    """SELECT * FROM (VALUES (0, 0, 0, 0, 0, 0, 0, 0, 0, 0), (1, 1, 4, 9, 0, 0, 0, 3, 0, 0), (2, 2, 1, 2, 0, 0, 0, 0, 0, 0),
       (3, 1, 0, 0, 0, 1, 0, 0, 0, 0), (4, 4, 4, 12, 0, 0, 0, 0, 0, 0), (5, 0, 0, 0, 0, 0, 1, 0, 0, 1),
       (6, 1, 6, 5, 0, 0, 0, 6, 1, 0), (7, 1, 1, 0, 2, 0, 0, 2, 0, -1))
       AS t(ending, taken, ec, eh, eo, ef, ena, own, rings, charge)""",
)
_view(
    "composed",
    """SELECT *, c + ec AS nc, o + eo AS no, ef AS nf, ena AS nna,
       CASE WHEN family = 'alkene' THEN 2 * c ELSE 2 * c + 2 END - least(taken, free) + eh AS nh,
       c + o - 1 + CASE ending WHEN 0 THEN 0 WHEN 4 THEN 4 WHEN 5 THEN 0 ELSE 1 END + own AS n_bonds
FROM ended JOIN endings USING (ending)""",
    ("ended", "endings"),
)
_view(
    "doc_values",
    """SELECT doc_id, unnest(list_filter(['a:' || lower(left(text, 24)), 'b:' || text, 'c:' || concat_ws(':', source, n_chars)],
       lambda x: x IS NOT NULL)) AS v FROM documents""",
)
_view("doc_links", "SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM doc_values a JOIN doc_values b ON a.v = b.v", ("doc_values",))
_view(
    "doc_reached",
    """SELECT doc_id AS x, doc_id AS root FROM documents
       UNION SELECT l.y, r.root FROM doc_reached r JOIN doc_links l ON r.x = l.x""",
    ("doc_links",),
)
_view(
    "doc_groups",
    "SELECT x AS doc_id, min(root) AS group_id FROM doc_reached GROUP BY x",
    ("doc_reached",),
)
_view("group_sizes", "SELECT row_number() OVER (ORDER BY count(*) DESC) AS i, count(*) AS n FROM doc_groups GROUP BY group_id", ("doc_groups",))
_view(
    "reachable",
    """SELECT 0::BIGINT AS i, 0::BIGINT AS total UNION
       SELECT g.i, unnest([r.total, r.total + g.n]) FROM reachable r JOIN group_sizes g ON g.i = r.i + 1
       WHERE r.total <= 2 * (SELECT count(*) FROM documents) // 5""",
    ("group_sizes",),
)
_view(
    "registry",
    "SELECT * FROM (VALUES "
    + ", ".join(
        f"({_quoted(r['property'])}, {r['base']}::DOUBLE, {r['slope']}::DOUBLE, {r['noise']}::DOUBLE)"
        for r in REGISTRY
    )
    + ") AS t(property, base, slope, noise)",
)
_view(
    "property_values",
    """SELECT mol_id, family, carbons, property,
       round(base + slope * carbons + (label - 950) * noise, 6) AS value
FROM molecules CROSS JOIN registry""",
    ("molecules", "registry"),
)
_view(
    "predictions",
    """SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_key,
       l_returnflag AS grp, l_extendedprice AS y,
       0.9::DOUBLE * l_extendedprice + 100 * l_quantity AS y_pred
FROM lineitem""",
)
_view(
    "trials",
    "SELECT user_id % 20 AS study, event_id AS trial_id, floor(value)::DOUBLE AS value FROM events",
)
_view(
    "epoch_log",
    """SELECT user_id AS run, datediff('day', DATE '2024-01-01', ts::DATE)::BIGINT AS epoch,
       round(avg(value), 7) AS eval_loss, count(value) AS n
FROM events GROUP BY 1, 2""",
)
_view(
    "doc_labels",
    "SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
_DOT = "list_dot_product(embedding::DOUBLE[], range(1, 65)::DOUBLE[])"
_view("planted", f"SELECT vec_id, embedding, {_DOT} AS target FROM embeddings")
_view(
    "mixed_tokens",
    rf"""SELECT mol_id, smiles, flatten(list_transform(regexp_extract_all(smiles, {_quoted(S.OUTER_GLYPH)}),
       lambda t: CASE WHEN starts_with(t, '[') AND length(t) > 1
                      THEN regexp_extract_all(t, {_quoted(S.INNER_GLYPH)}) ELSE [t] END)) AS tokens
FROM mixed""",
    ("mixed",),
)
_view(
    "mixed_vocab",
    """SELECT token, count(*) AS n,
       (row_number() OVER (ORDER BY count(*) DESC, token) + 2)::INT AS id
FROM (SELECT unnest(tokens) AS token FROM mixed_tokens) GROUP BY token""",
    ("mixed_tokens",),
)
_view(
    "mixed_ids",
    """SELECT e.mol_id, e.pos, v.id FROM (
         SELECT mol_id, unnest(tokens) AS token, unnest(range(1, len(tokens) + 1))::INT AS pos FROM mixed_tokens) e
       JOIN mixed_vocab v ON e.token = v.token
       UNION ALL SELECT mol_id, 0 AS pos, 2 AS id FROM mixed_tokens""",
    ("mixed_tokens", "mixed_vocab"),
)
_view(
    "words",
    f"""SELECT doc_id, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS pos
FROM (SELECT doc_id, regexp_extract_all(lower(text), {_quoted(S.WORD)}) AS w FROM documents)""",
)
_view(
    "word_vocab",
    """SELECT token, count(*) AS n, (row_number() OVER (ORDER BY count(*) DESC, token) + 2)::INT AS id
FROM words GROUP BY token""",
    ("words",),
)
_view(
    "document_ids",
    """SELECT doc_id, list(id ORDER BY pos) AS ids FROM (
         SELECT w.doc_id, w.pos, v.id FROM words w JOIN word_vocab v ON w.token = v.token
         UNION ALL SELECT doc_id, 0 AS pos, 2 AS id FROM documents) GROUP BY doc_id""",
    ("words", "word_vocab"),
)
_view(
    "doc_sides",
    """SELECT doc_id, n_chars::DOUBLE AS labels, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id))
                       <= (SELECT (count(*) + 4) // 5 FROM documents) THEN 'test' ELSE 'train' END AS split
FROM documents""",
)
_view(
    "train_vocab",
    """SELECT token, (row_number() OVER (ORDER BY count(*) DESC, token) + 2)::INT AS id
FROM words WHERE doc_id IN (SELECT doc_id FROM doc_sides WHERE split = 'train') GROUP BY token""",
    ("words", "doc_sides"),
)
_view(
    "train_ids",
    """SELECT w.doc_id, w.pos, coalesce(k.id, 1) AS id FROM words w LEFT JOIN train_vocab k ON w.token = k.token
UNION ALL SELECT doc_id, 0, 2 FROM doc_sides""",
    ("words", "doc_sides", "train_vocab"),
)
_view(
    "checked",
    rf"""SELECT *, list_filter([
         CASE WHEN trim(smiles) = '' THEN 'empty' END,
         CASE WHEN regexp_matches(skeleton, '[\[\]]') THEN 'bracket' END,
         CASE WHEN regexp_matches(skeleton, {_quoted(S.ILLEGAL_CHARACTER)}) THEN 'charset' END,
         CASE WHEN list_reduce(list_transform(regexp_extract_all(skeleton, '[()]'),
                                              lambda p: CASE WHEN p = '(' THEN 1 ELSE -1 END),
                               lambda a, s: CASE WHEN a < 0 THEN a ELSE a + s END, 0) <> 0 THEN 'paren' END,
         CASE WHEN regexp_matches(skeleton, {_quoted(S.DANGLING_BOND)}) THEN 'dangling' END,
         CASE WHEN regexp_matches(skeleton, {_quoted(S.LONE_PERCENT)})
                OR len(list_filter(list_distinct(rings),
                                   lambda r: len(list_filter(rings, lambda o: o = r)) % 2 = 1)) > 0
              THEN 'ring' END], lambda r: r IS NOT NULL) AS reasons,
       len(regexp_extract_all(skeleton, {_quoted(S.AROMATIC_ATOM)}))
       + len(regexp_extract_all(smiles, {_quoted(S.AROMATIC_BRACKET_ATOM)})) AS atoms
FROM (SELECT *, list_transform(regexp_extract_all(skeleton, {_quoted(S.RING_LABEL)}),
                               lambda t: replace(t, '%', '')::INT) AS rings
      FROM (SELECT *, regexp_replace(smiles, {_quoted(S.BRACKET_ATOM)}, '*', 'g') AS skeleton FROM mixed))""",
    ("mixed",),
)
_view(
    "verdicts",
    """SELECT *, CASE WHEN len(reasons) > 0 THEN reasons[1] WHEN atoms > 0 THEN 'aromatic' ELSE 'ok' END AS verdict
FROM checked""",
    ("checked",),
)
_view(
    "mol_split",
    """SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('42:' || mol_id))
                       <= (SELECT (count(*) + 4) // 5 FROM molecules)
            THEN 'test' ELSE 'train' END AS split
FROM molecules""",
    ("molecules",),
)
_view(
    "line_rank",
    "SELECT *, row_number() OVER (ORDER BY md5('42:' || row_key), row_key) AS rank FROM predictions",
    ("predictions",),
)
_view(
    "line_subset",
    "SELECT *, row_number() OVER (ORDER BY md5('42:subset:' || row_key), row_key) AS place FROM predictions",
    ("predictions",),
)
_view(
    "line_split",
    """SELECT *, CASE WHEN rank <= (SELECT (count(*) + 4) // 5 FROM lineitem) THEN 'test' ELSE 'train' END AS split
FROM line_rank""",
    ("line_rank",),
)
_view(
    "mol_batches",
    """SELECT mol_id, (row_number() OVER (ORDER BY md5('42:' || mol_id)) - 1) // 32 AS batch_id,
       (len(tokens) + 1)::INT AS n_tokens
FROM mixed_tokens""",
    ("mixed_tokens",),
)


_view("pack_order", "SELECT n_tokens, row_number() OVER (ORDER BY n_tokens DESC, mol_id) AS i FROM mol_batches", ("mol_batches",))
# one sequence at a time, the longest first, into the least space that takes it
_view(
    "pack_spaces",
    """SELECT 0::BIGINT AS i, []::BIGINT[] AS spaces UNION ALL
       SELECT o.i, CASE WHEN fit IS NULL THEN list_append(spaces, 128 - n_tokens)
                        ELSE list_append(list_concat(spaces[:spot - 1], spaces[spot + 1:]), fit - n_tokens) END
       FROM (SELECT p.spaces, o.i, o.n_tokens, list_min(list_filter(p.spaces, lambda x: x >= o.n_tokens)) AS fit,
                    list_position(p.spaces, list_min(list_filter(p.spaces, lambda x: x >= o.n_tokens))) AS spot
             FROM pack_spaces p JOIN pack_order o ON o.i = p.i + 1) o""",
    ("pack_order",),
)


def _uniform(parameter: str) -> str:
    digest = f"md5('42:{parameter}:' || study || ':' || trial_id)"
    return f"(('0x' || substr({digest}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


_view(
    "drawn",
    f"""SELECT study, trial_id,
       0.5::DOUBLE * {_uniform('dropout')} AS dropout,
       (1 + floor({_uniform('num_hidden_layers')} * 3))::INT AS num_hidden_layers,
       exp(ln(1e-6::DOUBLE) + {_uniform('learning_rate')} * (ln(1e-3::DOUBLE) - ln(1e-6::DOUBLE))) AS learning_rate,
       ([16, 32, 64])[floor({_uniform('batch_size')} * 3)::INT + 1]::INT AS batch_size
FROM (SELECT user_id % 20 AS study, event_id AS trial_id FROM events)""",
)
_view(
    "trial_bins",
    """SELECT study, rank <= ceil(0.25 * n) AS good, unnest([
           {'dimension': 'dropout', 'bins': 32, 'reach': 4, 'bin': least(floor(dropout / 0.5 * 32), 31)::INT},
           {'dimension': 'num_hidden_layers', 'bins': 3, 'reach': 1, 'bin': num_hidden_layers - 1},
           {'dimension': 'learning_rate', 'bins': 32, 'reach': 4,
            'bin': least(floor((ln(learning_rate) - ln(1e-6::DOUBLE)) / (ln(1e-3::DOUBLE) - ln(1e-6::DOUBLE)) * 32), 31)::INT},
           {'dimension': 'batch_size', 'bins': 3, 'reach': 1, 'bin': list_position([16, 32, 64], batch_size) - 1}], recursive := true)
       FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY value, trial_id) AS rank, count(*) OVER (PARTITION BY study) AS n
             FROM drawn JOIN trials USING (study, trial_id))""",
    ("drawn", "trials"),
)
_view(
    "trial_densities",
    """SELECT study, dimension, b::INT AS bin,
       1 + sum(CASE WHEN good THEN greatest(reach - abs(b - bin), 0) ELSE 0 END)::BIGINT AS good,
       1 + sum(CASE WHEN good THEN 0 ELSE greatest(reach - abs(b - bin), 0) END)::BIGINT AS other
FROM trial_bins, range(32) AS r(b) WHERE b < bins GROUP BY ALL""",
    ("trial_bins",),
)
_view(
    "trial_steps",
    "SELECT *, sum(good) OVER (PARTITION BY study, dimension ORDER BY bin) AS cum, ln(good) - ln(other) AS score FROM trial_densities",
    ("trial_densities",),
)
_DRAW = "md5('42:' || dimension || '{}:' || study || ':' || last || ':' || draw)"
_view(
    "trial_draws",
    f"""SELECT study, last, draw, dimension, arg_min(bin, bin) FILTER (cum > u * total) AS bin, arg_min(score, bin) FILTER (cum > u * total) AS score,
       any_value(w) AS w
FROM (SELECT *, ('0x' || substr({_DRAW.format('')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
             ('0x' || substr({_DRAW.format(' within')}, 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS w,
             sum(good) OVER (PARTITION BY study, dimension, draw) AS total
      FROM trial_steps JOIN (SELECT study, max(trial_id) AS last FROM trials GROUP BY study) USING (study), range(24) AS r(draw))
GROUP BY study, last, draw, dimension""",
    ("trial_steps", "trials"),
)
_view(
    "trend",
    """SELECT property, family, carbons, count(value) AS n, avg(value) AS mean_value,
       min(value) AS min_value, max(value) AS max_value
FROM property_values GROUP BY ALL""",
    ("property_values",),
)


def _metrics(source: str, y: str = "y", p: str = "y_pred") -> str:
    return f"""count(*) AS n, round(avg(abs({p} - {y})), 4) AS mae,
       round(avg(({p} - {y}) * ({p} - {y})), 2) AS mse,
       round(sqrt(avg(({p} - {y}) * ({p} - {y}))), 4) AS rmse,
       round(1 - sum(({p} - {y}) * ({p} - {y})) / nullif(count(*) * var_pop({y}), 0), 4) AS r2
FROM {source}"""


def _profile(column: str, kind: str, number: bool) -> str:
    low, high = (f"min({column})::DOUBLE", f"max({column})::DOUBLE") if number else ("NULL::DOUBLE",) * 2
    return f"""SELECT '{column}' AS "column", '{kind}' AS type, count(*) AS n_rows,
       count(*) - count({column}) AS n_null, count(DISTINCT {column}) AS n_distinct,
       {low} AS min_value, {high} AS max_value FROM profiled"""


def _compare(on: str, source: str) -> str:
    return f"""SELECT property, {on}, a AS alcohol_value, e AS alkene_value,
       round(a - e, 8) AS delta, a - e > 0 AS holds
FROM (SELECT property, {on}, round(avg(value) FILTER (family = 'alcohol'), 8) AS a,
             round(avg(value) FILTER (family = 'alkene'), 8) AS e
      FROM {source} GROUP BY ALL)
WHERE a IS NOT NULL AND e IS NOT NULL"""


def all_oracles() -> dict[str, str]:
    plain = {
        "kekulize": """SELECT mol_id, kind <> 3 AS accepted,
                      CASE kind WHEN 0 THEN 3 * k WHEN 1 THEN 2 * k + 1 WHEN 2 THEN 2 * k WHEN 4 THEN 1 ELSE 0 END AS n_double, 0 AS n_lower,
                      CASE kind WHEN 0 THEN format('C{}H{}', 6 * k, 4 * k + 2) WHEN 1 THEN format('C{}H{}', 4 * k + 2, 2 * k + 4)
                                WHEN 2 THEN format('C{}H{}S', 4 * k, 2 * k + 2) || if(k > 1, k::VARCHAR, '') WHEN 3 THEN ''
                                ELSE format('C{}H{}', greatest(p_size, 2), 2 * greatest(p_size, 2)) END AS formula
               FROM (SELECT p_partkey AS mol_id, p_partkey % 5 AS kind, p_size % 6 + 1 AS k, p_size FROM part)""",
        "rename_select": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
            l_extendedprice AS labels FROM lineitem""",
        "series_generate": f"""SELECT mol_id, family, name, n::INT AS carbons, smiles FROM (
            SELECT mol_id, n, 'alkene' AS family, 'C' || n || ' Alkene' AS name,
                   'C=C' || repeat('C', greatest(n - 2, 0)) AS smiles
            FROM (SELECT p_partkey AS mol_id, unnest(range(2, greatest(p_size, 2) + 1, 2)) AS n FROM part)
            UNION ALL
            SELECT mol_id, n, 'alcohol', 'C' || n || ' Alcohol', repeat('C', greatest(n - 1, 1)) || 'O'
            FROM (SELECT p_partkey AS mol_id, unnest(range(2, greatest(p_size, 2) + 1, 2)) AS n FROM part))""",
        "series_union": f"""SELECT p_partkey AS mol_id, 'alkene' AS family, 'C' || p_size || ' Alkene' AS name,
                   p_size::INT AS carbons, {_ALKENE} AS smiles FROM part
            UNION ALL SELECT p_partkey, 'alcohol', 'C' || p_size || ' Alcohol', p_size::INT,
                   repeat('C', greatest(p_size, 1)) || 'O' FROM part""",
        "pool_first": """SELECT vec_id, unnest(range(0, 64))::INT AS pos,
            unnest(embedding)::DOUBLE AS x FROM embeddings""",
        "key_unique": """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
            GROUP BY ALL HAVING count(*) > 1""",
        "pred_label_join": """SELECT a.event_id, round(5 + a.value * 0.9::DOUBLE, 4) AS y_pred, b.value AS y
            FROM events a JOIN events b ON a.event_id = b.event_id""",
        "score_hidden": """SELECT vec_id, round(0.5 + sum(i * (x + 100)), 4) AS y_pred
            FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS i FROM embeddings)
            WHERE i % 2 = 1 GROUP BY vec_id""",
        "copy_number": """SELECT l_returnflag, count(*) AS n_rows, count(*) AS n_copies, count(*) AS last_copy
            FROM lineitem GROUP BY ALL""",
        "finetune_report": f"""WITH ranked AS (
              SELECT l_returnflag, l_quantity AS x, l_extendedprice AS y, row_number() OVER (ORDER BY
                md5(concat_ws(':', '42', l_orderkey, l_linenumber, l_partkey, l_suppkey))) AS r FROM lineitem),
            k AS (SELECT (count(*) + 4) // 5 AS k FROM lineitem),
            line AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM ranked, k WHERE r > k),
            scored AS (SELECT l_returnflag, y, b + a * x AS y_pred FROM ranked, k, line WHERE r <= k)
            SELECT l_returnflag, GROUPING(l_returnflag)::INT AS level, {_metrics('scored')} GROUP BY ROLLUP (l_returnflag)""",
        "score_linear": f"SELECT vec_id, round(0.5 + {_DOT}, 6) AS y_pred FROM embeddings",
        "dataset_profile": """WITH profiled AS (
              SELECT d.doc_id, d.n_chars, l.quality, d.lang, d.source
              FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
            """
        + " UNION ALL ".join(
            _profile(*c)
            for c in [
                ("doc_id", "bigint", True),
                ("n_chars", "bigint", True),
                ("quality", "int", True),
                ("lang", "string", False),
                ("source", "string", False),
            ]
        ),
    }
    views = {
        "csv_scan": (
            """SELECT mol_id, smiles, CASE WHEN carbons <> 13 THEN round(label, 4) END AS label,
               carbons = 13 AS corrupt FROM molecules""",
            "molecules",
        ),
        "dataset_preview": ("SELECT * FROM molecules ORDER BY mol_id LIMIT 5", "molecules"),
        "score_roundtrip": ("SELECT mol_id, value, property FROM property_values", "property_values"),
        "head_roundtrip": ("SELECT vec_id, round(target, 4) AS y_pred FROM planted", "planted"),
        "validate_reasons": (
            """SELECT mol_id, smiles, array_to_string(reasons, ',') AS reasons, verdict,
               atoms > 0 AS has_aromatic FROM verdicts""",
            "verdicts",
        ),
        "validate_accept": (
            "SELECT len(reasons) = 0 AS accepted, verdict, count(*) AS n_rows FROM verdicts GROUP BY ALL",
            "verdicts",
        ),
        "aromatic_audit": (
            """SELECT source, count(*) AS n_rows, count(*) FILTER (atoms > 0) AS n_aromatic,
               sum(atoms)::BIGINT AS aromatic_atoms,
               round(count(*) FILTER (atoms > 0) / count(*), 9) AS share
               FROM checked GROUP BY source""",
            "checked",
        ),
        "tokenize": (
            """SELECT mol_id, unnest(range(0, len(tokens)))::INT AS pos, unnest(tokens) AS token
               FROM mixed_tokens""",
            "mixed_tokens",
        ),
        "vocab_build": ("SELECT token, n, id FROM mixed_vocab", "mixed_vocab"),
        "vocab_documents": ("SELECT token, n, id FROM word_vocab", "word_vocab"),
        "encode": ("SELECT mol_id, pos::INT AS pos, id FROM mixed_ids", "mixed_ids"),
        "encode_documents": (
            """SELECT doc_id, len(ids)::INT AS n_tokens, md5(array_to_string(ids, ',')) AS digest
               FROM document_ids""",
            "document_ids",
        ),
        "encode_roundtrip": ("SELECT mol_id, smiles FROM mixed", "mixed"),
        "pad_fixed": (
            """SELECT doc_id, len(ids)::INT AS n_tokens, greatest(len(ids), 512)::INT AS padded,
               greatest(512 - len(ids), 0)::INT AS n_pad, len(ids) > 512 AS overflow FROM document_ids""",
            "document_ids",
        ),
        "pad_batch": (
            """SELECT mol_id, batch_id, n_tokens, max(n_tokens) OVER (PARTITION BY batch_id) AS width,
               max(n_tokens) OVER (PARTITION BY batch_id) AS padded, n_tokens AS n_real FROM mol_batches""",
            "mol_batches",
        ),
        "pad_waste": (
            """SELECT batch_id, count(*) AS n_rows, max(n_tokens) AS width,
               round(1 - sum(n_tokens) / (count(*) * max(n_tokens)), 9) AS waste
               FROM mol_batches GROUP BY batch_id""",
            "mol_batches",
        ),
        "pack_waste": (
            """SELECT n_tokens, count(*) AS n_packs, round(1 - n_tokens / 128, 9) AS waste
               FROM (SELECT 128 - unnest(spaces) AS n_tokens FROM pack_spaces
                     WHERE i = (SELECT count(*) FROM mol_batches)) GROUP BY n_tokens""",
            "pack_spaces",
            "mol_batches",
        ),
        "pack_check": (
            """SELECT count(*) AS n_rows, count(*) AS n_placed, 0::BIGINT AS n_beyond, 0::BIGINT AS n_misplaced
               FROM mol_batches WHERE n_tokens BETWEEN 1 AND 128""",
            "mol_batches",
        ),
        "batch_assign": ("SELECT row_key, (rank - 1) // 32 AS batch_id FROM line_rank", "line_rank"),
        "unwrap_prediction": ("SELECT mol_id, property, value FROM property_values", "property_values"),
        "parity_table": (
            """SELECT row_key, round(y, 4) AS actual, round(y_pred, 4) AS predicted,
               round(abs(y_pred - y), 4) AS residual FROM predictions""",
            "predictions",
        ),
        "parity_hist": (
            """SELECT least(floor((y - low) / width), 49)::INT AS actual_bin,
                   least(floor((y_pred - low) / width), 49)::INT AS predicted_bin,
                   count(*) AS n, round(avg(abs(y_pred - y)), 4) AS mean_residual
               FROM predictions, (SELECT low, (high - low) / 50 AS width FROM (
                   SELECT least(min(y), min(y_pred)) AS low, greatest(max(y), max(y_pred)) AS high
                   FROM predictions))
               GROUP BY ALL""",
            "predictions",
        ),
        "mse_nullable": (
            """SELECT count(*) AS n_rows, count(quality) AS n_labelled,
               round(avg((0.25 + n_chars * 0.0001::DOUBLE - quality) * (0.25 + n_chars * 0.0001::DOUBLE - quality)), 9)
                 AS mse
               FROM doc_labels""",
            "doc_labels",
        ),
        "split_exact": ("SELECT mol_id, split FROM mol_split", "mol_split"),
        "split_exact_lines": ("SELECT row_key, split FROM line_split", "line_split"),
        "split_hash": (
            """SELECT row_key, CASE WHEN ('0x' || substr(md5('42:' || row_key), 1, 13))::BIGINT
                                         / 4503599627370496.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split
               FROM predictions""",
            "predictions",
        ),
        "score_cross": ("SELECT * FROM property_values", "property_values"),
        "pred_attr_join": (
            """SELECT v.mol_id, v.property, v.value, m.family, m.carbons
               FROM property_values v JOIN molecules m ON v.mol_id = m.mol_id""",
            "property_values",
        ),
        "family_compare": (_compare("carbons", "property_values"), "property_values"),
        "family_compare_counted": (
            _compare(
                "carbon_count",
                """(SELECT v.property, v.family, v.value,
                       (len(m.smiles) - len(replace(m.smiles, 'C', '')))::INT AS carbon_count
                    FROM property_values v JOIN molecules m ON v.mol_id = m.mol_id)""",
            ),
            "property_values",
        ),
        "property_order": (
            """SELECT mol_id, melting, flash, boiling, melting < flash AND flash < boiling AS ordered FROM (
               SELECT mol_id, max(value) FILTER (property = 'Melting Point') AS melting,
                      max(value) FILTER (property = 'Flash Point') AS flash,
                      max(value) FILTER (property = 'Boiling Point') AS boiling
               FROM property_values GROUP BY mol_id)""",
            "property_values",
        ),
        "split_overlap": (
            """SELECT count(*) AS n_values, count(*) FILTER (a > 0 AND b > 0) AS shared_values,
                   coalesce(sum(a) FILTER (b > 0), 0)::BIGINT AS shared_train_rows,
                   coalesce(sum(b) FILTER (a > 0), 0)::BIGINT AS shared_test_rows
               FROM (SELECT smiles, count(*) FILTER (split = 'train') AS a,
                            count(*) FILTER (split = 'test') AS b FROM mol_split GROUP BY smiles)""",
            "mol_split",
        ),
        "split_shared_values": (
            """SELECT a.smiles, a.n AS train_rows, b.n AS test_rows
               FROM (SELECT smiles, count(*) AS n FROM mol_split WHERE split = 'train' GROUP BY smiles) a
               JOIN (SELECT smiles, count(*) AS n FROM mol_split WHERE split = 'test' GROUP BY smiles) b
               ON a.smiles = b.smiles""",
            "mol_split",
        ),
        "regression_report": (f"SELECT {_metrics('predictions')}", "predictions"),
        "regression_report_by": (
            f"SELECT grp, GROUPING(grp)::INT AS level, {_metrics('predictions')} GROUP BY ROLLUP (grp)",
            "predictions",
        ),
        "epoch_loss": ("SELECT run, epoch, eval_loss, n FROM epoch_log", "epoch_log"),
        "best_trial": (
            """SELECT study, trial_id, value FROM (SELECT *, row_number() OVER (
                   PARTITION BY study ORDER BY value, trial_id) AS r FROM trials) WHERE r = 1""",
            "trials",
        ),
        "trend_check": (
            """SELECT property, family, count(*) AS n_points, count(*) FILTER (point <= last) AS violations,
                   round(regr_slope(point, carbons::DOUBLE), 6) AS slope,
                   count(*) FILTER (point <= last) = 0 AS monotone
               FROM (SELECT *, lag(point) OVER (PARTITION BY property, family ORDER BY carbons) AS last
                     FROM (SELECT *, round(mean_value, 9) AS point FROM trend))
               GROUP BY property, family""",
            "trend",
        ),
        "best_so_far": (
            """SELECT study, trial_id, value, best_value,
                   CASE WHEN best_value > 0 THEN round(log10(best_value), 9) END AS log10_best
               FROM (SELECT *, min(value) OVER (PARTITION BY study ORDER BY trial_id
                     ROWS UNBOUNDED PRECEDING) AS best_value FROM trials)""",
            "trials",
        ),
        "checkpoint_retention": (
            """SELECT run, epoch, eval_loss, is_best FROM (
                 SELECT *, row_number() OVER (PARTITION BY run ORDER BY is_best DESC, epoch DESC) AS place
                 FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY eval_loss, epoch) = 1 AS is_best
                       FROM epoch_log))
               WHERE place <= 2""",
            "epoch_log",
        ),
        "global_rank": ("SELECT row_key, rank FROM line_rank", "line_rank"),
        "sorted_rank": (
            """SELECT row_key, round(y, 2) AS y,
                   row_number() OVER (ORDER BY round(y, 2) DESC, row_key) AS rank FROM predictions""",
            "predictions",
        ),
        "head_n": (
            "SELECT row_key, round(y, 4) AS y FROM line_subset WHERE place <= 5000",
            "line_subset",
        ),
        "trial_topk": (
            """SELECT study, trial_id, value, row_number() OVER (ORDER BY value, trial_id)::INT AS place
               FROM trials QUALIFY place <= 10""",
            "trials",
        ),
        "trial_topk_by_study": (
            """SELECT study, trial_id, value,
                   row_number() OVER (PARTITION BY study ORDER BY value, trial_id)::INT AS place
               FROM trials QUALIFY place <= 5""",
            "trials",
        ),
        "split_partition_check": (
            """SELECT count(*) AS n_rows, count(*) FILTER (split = 'train') AS n_train,
                   count(*) FILTER (split = 'test') AS n_test,
                   (SELECT count(*) FROM (SELECT row_key FROM predictions EXCEPT ALL SELECT row_key FROM line_split))
                     AS missing_keys,
                   (SELECT count(*) FROM (SELECT row_key FROM line_split EXCEPT ALL SELECT row_key FROM predictions))
                     AS extra_keys,
                   (SELECT count(*) FROM (SELECT row_key FROM line_split WHERE split = 'train' INTERSECT
                                          SELECT row_key FROM line_split WHERE split = 'test')) AS shared_keys
               FROM line_split""",
            "line_split",
        ),
        "split_reuse": (
            """SELECT least(count(*), 1000)::BIGINT AS n_left, count(*) AS n_right, least(count(*), 1000)::BIGINT AS n_shared
               FROM line_split WHERE split = 'test'""",
            "line_split",
        ),
        "split_three": (
            """SELECT row_key, CASE WHEN rank <= (n + 4) // 5 THEN 'test'
                   WHEN rank <= (n + 4) // 5 + (n + 9) // 10 THEN 'val' ELSE 'train' END AS split
               FROM line_rank, (SELECT count(*) AS n FROM lineitem)""",
            "line_rank",
        ),
        "csv_accepted": ("SELECT smiles FROM molecules WHERE carbons <> 13", "molecules"),
        "csv_counts": (
            """SELECT count(*) FILTER (carbons <> 13) AS n_good, count(*) FILTER (carbons = 13) AS n_bad FROM molecules""",
            "molecules",
        ),
        "decode_documents": (
            """SELECT d.doc_id, coalesce(string_agg(w.token, ' ' ORDER BY w.pos), '') AS words
               FROM documents d LEFT JOIN words w ON d.doc_id = w.doc_id GROUP BY d.doc_id""",
            "words",
        ),
        "prepare_documents": (
            """SELECT s.doc_id, s.split, s.labels, count(*)::INT AS n_tokens,
                   (count(*) FILTER (i.id = 1))::INT AS n_unknown,
                   md5(string_agg(i.id::VARCHAR, ',' ORDER BY i.pos)) AS digest
               FROM doc_sides s JOIN train_ids i ON s.doc_id = i.doc_id GROUP BY ALL""",
            "train_ids",
        ),
        "saved_vocabulary": ("SELECT mol_id, pos::INT AS pos, id FROM mixed_ids", "mixed_ids"),
        "predict_map": (
            """SELECT mol_id, length(smiles)::DOUBLE AS y_pred FROM mixed""",
            "mixed",
        ),
        "sweep_objective": (
            """SELECT t AS trial_id, round(avg((target - t) * (target - t)), 4) AS value
               FROM (SELECT target, row_number() OVER (ORDER BY md5('42:' || vec_id)) AS r, (SELECT count(*) FROM planted) AS n
                     FROM planted), (SELECT unnest(range(5)) AS t)
               WHERE r <= (n + 4) // 5 GROUP BY t""",
            "planted",
        ),
        "search_space": (
            """SELECT study, trial_id, round(dropout, 12) AS dropout, num_hidden_layers,
                   round(learning_rate, 12) AS learning_rate, batch_size FROM drawn""",
            "drawn",
        ),
        "trial_densities": ("SELECT study, dimension, bin, good, other FROM trial_densities", "trial_densities"),
        "next_trials": (
            """SELECT study, last + place AS trial_id, round(0.5::DOUBLE * ((dropout + dropout_w) / 32), 12) AS dropout,
                   (num_hidden_layers + 1)::INT AS num_hidden_layers,
                   round(exp(ln(1e-6::DOUBLE) + (learning_rate + learning_rate_w) / 32 * (ln(1e-3::DOUBLE) - ln(1e-6::DOUBLE))), 12) AS learning_rate,
                   ([16, 32, 64])[batch_size + 1]::INT AS batch_size, round(score, 6) AS score
               FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY round(score, 9) DESC, draw) AS place
                     FROM (SELECT study, last, draw, sum(score) AS score,
                                  max(bin) FILTER (dimension = 'dropout') AS dropout, max(w) FILTER (dimension = 'dropout') AS dropout_w,
                                  max(bin) FILTER (dimension = 'num_hidden_layers') AS num_hidden_layers,
                                  max(bin) FILTER (dimension = 'learning_rate') AS learning_rate,
                                  max(w) FILTER (dimension = 'learning_rate') AS learning_rate_w,
                                  max(bin) FILTER (dimension = 'batch_size') AS batch_size
                           FROM trial_draws GROUP BY study, last, draw))
               WHERE place <= 3""",
            "trial_draws",
        ),
        "trials_tall": (
            """SELECT trial_id, dimension, round(value, 9) AS value,
                   round((value - low) / nullif(high - low, 0), 9) AS scaled
               FROM (SELECT *, min(value) OVER (PARTITION BY dimension) AS low,
                            max(value) OVER (PARTITION BY dimension) AS high
                     FROM (UNPIVOT (SELECT trial_id, dropout::DOUBLE AS dropout,
                                           num_hidden_layers::DOUBLE AS num_hidden_layers,
                                           learning_rate::DOUBLE AS learning_rate,
                                           batch_size::DOUBLE AS batch_size FROM drawn)
                           ON dropout, num_hidden_layers, learning_rate, batch_size
                           INTO NAME dimension VALUE value))""",
            "drawn",
        ),
        "example_atoms": (
            """SELECT mol_id, atom, symbol, aromatic, charge, degree, orders, hydrogens, fragment
               FROM mixed JOIN example_atoms USING (smiles)""",
            "mixed", "example_atoms",
        ),
        "example_bonds": (
            """SELECT mol_id, n::BIGINT AS n_bonds, ar::BIGINT AS n_aromatic, d::BIGINT AS n_double, 0 AS least, hi AS most
               FROM mixed JOIN (VALUES ('CCO', 2, 0, 0, 2), ('C=CC', 2, 0, 1, 2), ('C1CCCCC1', 6, 0, 0, 5), ('c1ccccc1', 6, 6, 3, 5),
                 ('C[C@@H](N)C(=O)[O-]', 5, 0, 1, 5), ('ClCCBr', 3, 0, 0, 3), ('C%12CCCCC%12', 6, 0, 0, 5),
                 ('Cn1cnc2c1c(=O)n(C)c(=O)n2C', 15, 10, 4, 13)) AS t(smiles, n, ar, d, hi) USING (smiles)""",
            "mixed",
        ),
        "chain_atoms": (
            """SELECT mol_id, atom::INT AS atom, CASE WHEN atom >= c THEN 'O' ELSE 'C' END AS symbol, degree, orders,
                      (CASE WHEN atom >= c THEN 2 ELSE 4 END - orders)::INT AS hydrogens, 0 AS fragment, true AS fits
               FROM (SELECT *, degree + (family = 'alkene' AND atom < 2)::INT AS orders
                     FROM (SELECT *, (atom > 0)::INT + (atom < c + o - 1)::INT AS degree
                           FROM (SELECT mol_id, family, c, o, unnest(range(c + o)) AS atom FROM ended)))""",
            "ended",
        ),
        "chain_bonds": (
            """SELECT mol_id, b::INT AS bond, b::INT AS a, (b + 1)::INT AS b, false AS aromatic,
                      CASE WHEN family = 'alkene' AND b = 0 THEN 2 ELSE 1 END AS "order"
               FROM (SELECT mol_id, family, unnest(range(c + o - 1)) AS b FROM ended)""",
            "ended",
        ),
        "chemical_verdicts": (
            "SELECT mol_id, smiles, CASE WHEN taken > free THEN 'valence' ELSE '' END AS reasons FROM composed",
            "composed",
        ),
        "molecule_composition": (
            """SELECT mol_id, 'C' || if(nc > 1, nc::VARCHAR, '') || if(nh > 0, 'H', '') || if(nh > 1, nh::VARCHAR, '') || if(nf > 0, 'F', '')
                      || if(nna > 0, 'Na', '') || if(no > 0, 'O', '') || if(no > 1, no::VARCHAR, '') AS formula,
                      nc + no + nf + nna AS n_atoms, n_bonds, 1 + nna AS n_fragments, rings AS n_rings, nh AS n_hydrogens, charge
               FROM composed""",
            "composed",
        ),
        "element_counts": (
            """SELECT source, symbol, sum(n)::BIGINT AS n_atoms, count(*) AS n_molecules, sum(h)::BIGINT AS hydrogens
               FROM (SELECT source, unnest(['C', 'O', 'F', 'Na']) AS symbol, unnest([nc, no, nf, nna]) AS n,
                            unnest([nh - oh, oh, 0, 0]) AS h
                     FROM (SELECT *, o * (taken = 0)::INT AS oh FROM composed WHERE taken <= free))
               WHERE n > 0 GROUP BY ALL""",
            "composed",
        ),
        "linked_documents": (
            "SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_rows FROM doc_groups",
            "doc_groups",
        ),
        "split_by_groups": (
            """SELECT (SELECT count(*) FROM documents) AS n_rows,
                      (SELECT total FROM reachable ORDER BY abs(total - (SELECT round_even(count(*) * 0.2, 0) FROM documents)), total LIMIT 1) AS n_test,
                      0::BIGINT AS shared_0, 0::BIGINT AS shared_1, 0::BIGINT AS shared_2""",
            "reachable",
        ),
        "trend_table": (
            """SELECT property, family, carbons, n, round(mean_value, 8) AS mean_value, min_value, max_value
               FROM trend""",
            "trend",
        ),
        "carbon_mismatch": (
            """SELECT mol_id, family, carbons, smiles, carbon_count FROM (
               SELECT *, (len(smiles) - len(replace(smiles, 'C', '')))::INT AS carbon_count FROM molecules)
               WHERE carbons <> carbon_count""",
            "molecules",
        ),
        "fit_linear_1d": (
            """SELECT grp, round(regr_slope(y, y_pred), 6) AS slope,
                   round(regr_intercept(y, y_pred), 6) AS intercept FROM predictions GROUP BY grp""",
            "predictions",
        ),
        "score_many_heads": (
            """SELECT vec_id, 'single' AS property, round(target, 4) AS value FROM planted
               UNION ALL SELECT vec_id, 'double', round(2 * target, 4) FROM planted""",
            "planted",
        ),
    }
    return plain | {name: _with(sql, *needs) for name, (sql, *needs) in views.items()}
