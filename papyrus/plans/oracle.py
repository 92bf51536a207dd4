"""DuckDB twins of the registered queries.

Each builder returns one ANSI-ish SQL string over the driver's base views
(``part``, ``lineitem``, ``supplier``, ``documents``, ``embeddings`` ...).
The derived inputs of :mod:`papyrus.sources.testdata` are repeated here as
CTEs, and iterative operators are unrolled into one CTE per step.
Doubles are rounded to :data:`DP` places on both sides.
"""

from __future__ import annotations

DP = 6

# ------------------------------------------------------------------ inputs

CITES = """cites AS (
  SELECT 'P' || CAST(s AS VARCHAR) AS src, 'P' || CAST(d AS VARCHAR) AS dst FROM (
    SELECT l_partkey AS s,
           lag(l_partkey) OVER (PARTITION BY l_orderkey
                                ORDER BY l_linenumber, l_partkey, l_suppkey) AS d
    FROM lineitem WHERE l_quantity > 40) e
  WHERE d IS NOT NULL
  UNION ALL
  SELECT 'P' || CAST(l_partkey AS VARCHAR), 'X' || CAST(l_orderkey AS VARCHAR)
  FROM lineitem WHERE l_orderkey % 500 = 0)"""

WROTE = """wrote AS (
  SELECT DISTINCT 'P' || CAST(l_partkey AS VARCHAR) AS paper_doi,
         CAST(l_suppkey AS INTEGER) AS author_id
  FROM lineitem WHERE l_linenumber = 1)"""

PAPERS = """papers AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS paper_doi,
         CASE WHEN p_partkey % 3 = 0 THEN 'The ' || p_name || ' of it' ELSE p_name END AS title,
         p_brand AS publishedby, p_partkey,
         CASE WHEN p_partkey % 13 = 0 THEN NULL
              ELSE CAST(1995 + p_partkey % 7 AS INTEGER) END AS publicationDate
  FROM part)"""

# one row per (paper, keyword phrase) of both keyword arrays, nulls skipped
KEYWORDS = """keywords AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS paper_doi, kw, pos FROM (
    SELECT p_partkey, p_brand AS kw, 1 AS pos FROM part WHERE p_partkey % 7 <> 0
    UNION ALL
    SELECT p_partkey, p_type, 2 FROM part WHERE p_partkey % 7 <> 0) k)"""

AUTHOR_KEYWORDS = """author_keywords AS (
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS paper_doi, w AS kw
  FROM part, unnest(string_split(p_name, ' ')) AS t(w)
  WHERE p_partkey % 11 <> 0)"""

AUTHORS = """authors AS (
  SELECT CAST(s_suppkey AS INTEGER) AS author_id, s_name AS author_name FROM supplier)"""

CORPUS = """raw AS (
  SELECT 'D' || CAST(CASE WHEN doc_id % 10 = 3 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS doi,
         CASE WHEN doc_id % 17 <> 0 THEN split_part(text, chr(10), 1) END AS title, text AS abstract
  FROM documents, range(CASE WHEN doc_id % 25 = 0 THEN 2 ELSE 1 END) t(n)),
corpus AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY doi, title, abstract) AS row, doi, title, abstract
  FROM (SELECT DISTINCT * FROM raw) r
  WHERE doi IS NOT NULL AND title IS NOT NULL AND abstract IS NOT NULL)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def dbl(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


# ------------------------------------------------------------------ graphs

def vertices_papers() -> str:
    return "V AS (SELECT DISTINCT paper_doi AS id FROM papers)"


def weights(edge_sql: str, name: str = "W") -> list[str]:
    """CTEs E (given), IE (internal), M (multiplicity) and W (weights)."""
    return [
        f"E AS ({edge_sql})",
        "IE AS (SELECT src, dst FROM E WHERE src IN (SELECT id FROM V) AND dst IN (SELECT id FROM V))",
        "M AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS m FROM IE GROUP BY src, dst)",
        f"{name} AS (SELECT M.src, M.dst, M.m / D.deg AS w FROM M "
        "JOIN (SELECT src, sum(m) AS deg FROM M GROUP BY src) D ON M.src = D.src)",
    ]


def undirected(edge_sql: str) -> str:
    return f"SELECT src, dst FROM ({edge_sql}) u UNION ALL SELECT dst, src FROM ({edge_sql}) r"


def personalized_steps(reset: float, iters: int, sources: str = "S") -> list[str]:
    """R0..R{iters}: sparse personalised state keyed by (source, id)."""
    keep = 1.0 - reset
    out = [f"R0 AS (SELECT source, source AS id, CAST(1.0 AS DOUBLE) AS r FROM {sources})"]
    for i in range(1, iters + 1):
        out.append(
            f"R{i} AS (SELECT source, id, "
            f"CASE WHEN id = source THEN {dbl(reset)} ELSE CAST(0.0 AS DOUBLE) END + {dbl(keep)} * sum(m) AS r "
            f"FROM (SELECT R{i-1}.source, W.dst AS id, R{i-1}.r * W.w AS m "
            f"FROM R{i-1} JOIN W ON R{i-1}.id = W.src "
            f"UNION ALL SELECT source, source, CAST(0.0 AS DOUBLE) FROM {sources}) x "
            f"GROUP BY source, id)")
    out.append(f"RN AS (SELECT R{iters}.source, id, r / t AS r FROM R{iters} "
               f"JOIN (SELECT source, sum(r) AS t FROM R{iters} GROUP BY source) T "
               f"ON R{iters}.source = T.source)")
    return out


def push_steps(reset: float, iters: int, push: float, sources: str = "S") -> list[str]:
    """Q0..Q{iters}: forward push; residuals of at least ``push`` per
    distinct out-edge move, smaller ones wait."""
    keep = 1.0 - reset
    moves = f"(r > 0 AND r >= {dbl(push)} * deg)"
    out = ["DEG AS MATERIALIZED (SELECT src, count(*) AS deg FROM W GROUP BY src)",
           f"Q0 AS MATERIALIZED (SELECT source, source AS id, coalesce(deg, 0) AS deg, CAST(0.0 AS DOUBLE) AS p, CAST(1.0 AS DOUBLE) AS r "
           f"FROM {sources} LEFT JOIN DEG ON DEG.src = source)"]
    for i in range(1, iters + 1):
        out.append(
            f"Q{i} AS MATERIALIZED (SELECT source, id, max(deg) AS deg, sum(p) AS p, sum(r) AS r FROM ("
            f"SELECT source, id, deg, p + CASE WHEN {moves} THEN {dbl(reset)} * r ELSE 0.0 END AS p, "
            f"CASE WHEN {moves} THEN CAST(0.0 AS DOUBLE) ELSE r END AS r FROM Q{i-1} "
            f"UNION ALL SELECT q.source, W.dst, coalesce(DEG.deg, 0), CAST(0.0 AS DOUBLE), {dbl(keep)} * q.r * W.w "
            f"FROM (SELECT * FROM Q{i-1} WHERE {moves}) q JOIN W ON q.id = W.src LEFT JOIN DEG ON DEG.src = W.dst) x "
            f"GROUP BY source, id)")
    out.append(f"RN AS (SELECT Q{iters}.source, id, (p + r) / t AS r FROM Q{iters} "
               f"JOIN (SELECT source, sum(p + r) AS t FROM Q{iters} GROUP BY source) T ON Q{iters}.source = T.source)")
    return out


def plain_steps(reset: float, iters: int) -> list[str]:
    keep = 1.0 - reset
    out = ["P0 AS (SELECT id, CAST(1.0 AS DOUBLE) AS r FROM V)"]
    for i in range(1, iters + 1):
        out.append(
            f"P{i} AS (SELECT id, {dbl(reset)} + {dbl(keep)} * sum(m) AS r FROM ("
            f"SELECT W.dst AS id, P{i-1}.r * W.w AS m FROM P{i-1} JOIN W ON P{i-1}.id = W.src "
            f"UNION ALL SELECT id, CAST(0.0 AS DOUBLE) FROM V) x GROUP BY id)")
    out.append(f"PN AS (SELECT id, r * (CAST((SELECT count(*) FROM P{iters}) AS DOUBLE) / (SELECT sum(r) FROM P{iters})) AS r "
               f"FROM P{iters})")
    return out


def delta_steps(reset: float, tol: float, steps: int) -> list[str]:
    """D0..D{steps}: delta propagation; a step without messages changes
    nothing, so any number of steps past the end gives the same state."""
    keep = 1.0 - reset
    out = [f"D0 AS MATERIALIZED (SELECT id, {dbl(reset)} AS pr, {dbl(reset)} AS delta, true AS active FROM V)"]
    for i in range(1, steps + 1):
        out.append(f"G{i} AS MATERIALIZED (SELECT W.dst AS id, sum(D{i-1}.delta * W.w) AS m FROM D{i-1} "
                   f"JOIN W ON D{i-1}.id = W.src WHERE D{i-1}.active AND D{i-1}.delta > {dbl(tol)} GROUP BY W.dst)")
        out.append(f"D{i} AS MATERIALIZED (SELECT D{i-1}.id, D{i-1}.pr + coalesce({dbl(keep)} * G{i}.m, 0.0) AS pr, "
                   f"CASE WHEN G{i}.m IS NULL THEN D{i-1}.delta ELSE {dbl(keep)} * G{i}.m END AS delta, "
                   f"G{i}.m IS NOT NULL AS active FROM D{i-1} LEFT JOIN G{i} ON D{i-1}.id = G{i}.id)")
    out.append(f"DN AS (SELECT id, pr * ((SELECT count(*) FROM D{steps}) / (SELECT sum(pr) FROM D{steps})) AS r "
               f"FROM D{steps})")
    return out


def lpa_steps(iters: int) -> list[str]:
    """L0..L{iters}: synchronous label propagation over symmetric edges
    ``ES(src, dst)``, most frequent label wins, ties to the smallest."""
    out = ["L0 AS (SELECT id, id AS label FROM VL)"]
    for i in range(1, iters + 1):
        out.append(
            f"C{i} AS (SELECT ES.dst AS id, L{i-1}.label, count(*) AS n "
            f"FROM ES JOIN L{i-1} ON ES.src = L{i-1}.id GROUP BY ES.dst, L{i-1}.label)")
        out.append(
            f"L{i} AS (SELECT L{i-1}.id, coalesce(b.label, L{i-1}.label) AS label FROM L{i-1} "
            f"LEFT JOIN (SELECT id, first(label ORDER BY n DESC, label) AS label FROM C{i} GROUP BY id) b "
            f"ON L{i-1}.id = b.id)")
    return out
