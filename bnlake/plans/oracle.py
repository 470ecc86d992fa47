"""DuckDB SQL for the oracle check, generated from the same spec.

These texts are written independently of the Spark plans: plain GROUP BYs
per (node, depth) instead of grouping sets, window row_number instead of
histogram cuts, and a brute-force join over the full hidden grid instead of
variable elimination.  They only need to be correct, not fast.
"""

from __future__ import annotations

from bnlake.functions.scalar import sql_uniform
from bnlake.sources.cases import RAW_CASES_SQL, RAW_DOCS_SQL
from bnlake.spec import DEFAULT_ALPHA, DEFAULT_M, DEFAULT_TEST_FRACTION, NetworkSpec

BIG = 2 ** 62


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def sql(ctes: list[str], select: str) -> str:
    body = ",\n".join(c.strip() for c in ctes if c)
    return f"WITH {body}\n{select}"


def sq(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class OracleSQL:
    """CTE builders for one network over one case view."""

    def __init__(self, spec: NetworkSpec, view: str = "cases", alpha: float = DEFAULT_ALPHA,
                 m: float = DEFAULT_M, backoff: bool = True,
                 test_fraction: float = DEFAULT_TEST_FRACTION):
        self.spec, self.view = spec, view
        self.alpha, self.m, self.backoff = alpha, m, backoff
        self.tf = test_fraction
        self.M = spec.max_parents
        self.pas = [f"pa{i}" for i in range(1, self.M + 1)]

    # -- views ------------------------------------------------------------
    def base(self) -> list[str]:
        spec = self.spec
        if self.view == "docs":
            raw, cols = RAW_DOCS_SQL, "*"
        else:
            raw, cols = RAW_CASES_SQL, "*, CAST(coalesce(minVotes, 0) > 0 AS INTEGER) AS voteSplit"
        feats = [n.column for n in spec.nodes if n.name != spec.target]
        nulls = " + ".join(f"CAST({c} IS NULL AS INTEGER)" for c in feats)
        rawname = "raw_docs" if self.view == "docs" else "raw_cases"
        return [raw,
                f"derived AS (SELECT {cols} FROM {rawname})",
                f"""prepared AS (SELECT * FROM derived
                    WHERE {spec.column(spec.target)} IS NOT NULL
                      AND CAST({nulls} AS DOUBLE) / {d(len(feats))} <= {d(0.5)})"""]

    def split_chrono(self) -> str:
        k = self.spec.key
        oc = self.spec.order_col
        return f"""split AS (
          SELECT *, row_number() OVER (ORDER BY coalesce(CAST({oc} AS BIGINT), {BIG}), {k})
                    <= CAST(floor(CAST(count(*) OVER () AS DOUBLE) * (1.0 - {d(self.tf)})) AS BIGINT)
                    AS is_train
          FROM prepared)"""

    def split_random(self, seed: int) -> str:
        k = self.spec.key
        u = sql_uniform(str(seed), k)
        return f"""split AS (
          SELECT *, row_number() OVER (ORDER BY {u}, {k})
                    <= CAST(floor(CAST(count(*) OVER () AS DOUBLE) * (1.0 - {d(self.tf)})) AS BIGINT)
                    AS is_train
          FROM prepared)"""

    def node_cols(self, names=None, src_alias: str = "") -> str:
        names = self.spec.names if names is None else names
        a = f"{src_alias}." if src_alias else ""
        return ", ".join(f"CAST({a}{self.spec.column(n)} AS VARCHAR) AS {n}" for n in names)

    def nodes(self, name: str = "train_nodes", source: str = "split",
              where: str = "is_train") -> str:
        spec = self.spec
        nn = " AND ".join(f"{spec.column(n)} IS NOT NULL" for n in spec.names)
        w = f"({where}) AND {nn}" if where else nn
        return f"{name} AS (SELECT {spec.key}, {self.node_cols()} FROM {source} WHERE {w})"

    # -- domains, counts, CPT ------------------------------------------------
    def domains(self, src: str = "train_nodes") -> list[str]:
        un = " UNION ALL ".join(f"SELECT {sq(n)} AS node, {n} AS value FROM {src}"
                                for n in self.spec.names)
        return [f"""domains AS (
          SELECT node, value, CAST(row_number() OVER (PARTITION BY node
                 ORDER BY TRY_CAST(value AS DOUBLE) NULLS LAST, value) AS INTEGER) AS ord
          FROM (SELECT DISTINCT node, value FROM ({un}) WHERE value IS NOT NULL))""",
                "card AS (SELECT node, count(*) AS V FROM domains GROUP BY node)"]

    def counts(self, src: str = "train_nodes") -> str:
        parts = []
        for n in self.spec.nodes:
            for dd in range(len(n.parents) + 1):
                pcols = [f"{n.parents[i]} AS pa{i + 1}" if i < dd else f"CAST(NULL AS VARCHAR) AS pa{i + 1}"
                         for i in range(self.M)]
                grp = ", ".join(list(n.parents[:dd]) + [n.name])
                parts.append(f"SELECT {sq(n.name)} AS node, {dd} AS depth, "
                             + ", ".join(pcols + [f"{n.name} AS value", "count(*) AS n"])
                             + f" FROM {src} GROUP BY {grp}")
        return "counts AS (" + "\nUNION ALL ".join(parts) + ")"

    def levels(self) -> list[str]:
        a, m, M, pas = self.alpha, self.m, self.M, self.pas
        nullpas = ", ".join(f"CAST(NULL AS VARCHAR) AS {p}" for p in pas)
        out = [f"""level_0 AS (
          SELECT dd.node, 0 AS depth, {nullpas}, dd.value, dd.ord,
                 CAST(coalesce(c.n, 0) AS BIGINT) AS n,
                 CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY dd.node) AS BIGINT) AS n_pa,
                 (CAST(coalesce(c.n, 0) AS DOUBLE) + {d(a)})
                   / (CAST(sum(coalesce(c.n, 0)) OVER (PARTITION BY dd.node) AS DOUBLE) + {d(a)} * CAST(k.V AS DOUBLE)) AS p
          FROM domains dd JOIN card k ON k.node = dd.node
          LEFT JOIN (SELECT node, value, n FROM counts WHERE depth = 0) c
            ON c.node = dd.node AND c.value = dd.value)"""]
        for k in range(1, M + 1):
            key = pas[:k]
            low = pas[:k - 1]
            gsel = ", ".join(f"g.{p}" for p in key)
            rest = ", ".join(f"CAST(NULL AS VARCHAR) AS {p}" for p in pas[k:])
            rest = (", " + rest) if rest else ""
            cj = " AND ".join([f"c.{p} = g.{p}" for p in key])
            lj = " AND ".join([f"lo.{p} = g.{p}" for p in low] + ["lo.node = g.node", "lo.value = dd.value"])
            part = ", ".join(["node"] + low)
            if self.backoff:
                lam = f"(CAST(g.n_pa AS DOUBLE) / (CAST(g.n_pa AS DOUBLE) + {d(m)}))"
                ml = f"(CASE WHEN g.n_pa > 0 THEN CAST(coalesce(c.n, 0) AS DOUBLE) / CAST(g.n_pa AS DOUBLE) ELSE 0.0 END)"
                p = f"{lam} * {ml} + (1 - {lam}) * coalesce(lo.p_low, 0.0)"
                lower = f"""LEFT JOIN (SELECT l.node, {', '.join('l.' + x for x in low) + ', ' if low else ''}l.value,
                    CASE WHEN sum(l.p) OVER (PARTITION BY {', '.join('l.' + x for x in part.split(', '))}) > 0
                         THEN l.p / sum(l.p) OVER (PARTITION BY {', '.join('l.' + x for x in part.split(', '))})
                         ELSE 1.0 / CAST(kk.V AS DOUBLE) END AS p_low
                  FROM level_{k - 1} l JOIN card kk ON kk.node = l.node) lo ON {lj}"""
            else:
                p = (f"(CAST(coalesce(c.n, 0) AS DOUBLE) + {d(self.alpha)}) / "
                     f"(CAST(g.n_pa AS DOUBLE) + {d(self.alpha)} * CAST(kc.V AS DOUBLE))")
                lower = "JOIN card kc ON kc.node = g.node"
            out.append(f"""cfg_{k} AS (SELECT node, {', '.join(key)}, sum(n) AS n_pa
                                FROM counts WHERE depth = {k} GROUP BY ALL)""")
            out.append(f"""level_{k} AS (
              SELECT g.node, {k} AS depth, {gsel}{rest}, dd.value, dd.ord,
                     CAST(coalesce(c.n, 0) AS BIGINT) AS n, CAST(g.n_pa AS BIGINT) AS n_pa, {p} AS p
              FROM cfg_{k} g JOIN domains dd ON dd.node = g.node
              LEFT JOIN (SELECT * FROM counts WHERE depth = {k}) c
                ON c.node = g.node AND {cj} AND c.value = dd.value
              {lower})""")
        out.append("cpt AS (" + " UNION ALL ".join(f"SELECT * FROM level_{k}" for k in range(M + 1)) + ")")
        return out

    def fit(self, src_nodes_cte: str) -> list[str]:
        return [src_nodes_cte, *self.domains(), self.counts(), *self.levels()]

    # -- factor grids (I3) ---------------------------------------------------
    def factors(self) -> str:
        pas, M = self.pas, self.M
        parts = []
        for n in self.spec.nodes:
            vs = list(n.parents) + [n.name]
            frm = ", ".join(f"domains x{i}" for i in range(len(vs)))
            wh = " AND ".join(f"x{i}.node = {sq(v)}" for i, v in enumerate(vs))
            pc = [f"x{i}.value AS pa{i + 1}" for i in range(len(n.parents))] + \
                 [f"CAST(NULL AS VARCHAR) AS pa{i + 1}" for i in range(len(n.parents), M)]
            last = len(vs) - 1
            parts.append(f"SELECT {sq(n.name)} AS node, {', '.join(pc)}, x{last}.value AS value, "
                         f"x{last}.ord AS ord FROM {frm} WHERE {wh}")
        grid = " UNION ALL ".join(parts)
        joins, ps = [], []
        for k in range(M, 0, -1):
            on = " AND ".join([f"l{k}.node = g.node", f"l{k}.value = g.value"] +
                              [f"l{k}.{p} = g.{p}" for p in pas[:k]])
            joins.append(f"LEFT JOIN (SELECT * FROM cpt WHERE depth = {k}) l{k} ON {on}")
            ps.append(f"l{k}.p")
        joins.append("LEFT JOIN (SELECT * FROM cpt WHERE depth = 0) l0 ON l0.node = g.node AND l0.value = g.value")
        joins.append("LEFT JOIN card kf ON kf.node = g.node")
        unseen = f"{d(self.alpha)} / ({d(self.alpha)} * CAST(greatest(coalesce(kf.V, 1), 1) AS DOUBLE) + {d(self.alpha)})"
        hit = "coalesce(" + ", ".join(f"CASE WHEN l{k}.p IS NOT NULL THEN {k} END" for k in range(M, 0, -1)) + ", 0)"
        gp = ", ".join(f"g.{p}" for p in pas)
        part = ", ".join(["node"] + pas)
        return f"""factor_raw AS (
          SELECT g.node, {gp}, g.value, g.ord, coalesce({', '.join(ps)}, l0.p, {unseen}) AS p0,
                 {hit} AS hit_depth
          FROM ({grid}) g {' '.join(joins)}),
        factors AS (
          SELECT node, {', '.join(pas)}, value, ord, hit_depth,
                 CASE WHEN sum(p0) OVER (PARTITION BY {part}) > 0
                      THEN p0 / sum(p0) OVER (PARTITION BY {part})
                      ELSE 1.0 / count(*) OVER (PARTITION BY {part}) END AS p
          FROM factor_raw)"""

    # -- evidence and brute-force posterior ------------------------------------
    def evidence(self, ev_vars: list[str], source: str = "split", where: str = "NOT is_train",
                 name: str = "ev") -> str:
        spec = self.spec
        cols = []
        for v in ev_vars:
            c = f"CAST({spec.column(v)} AS VARCHAR)"
            cols.append(f"CASE WHEN {c} IN (SELECT value FROM domains WHERE node = {sq(v)}) "
                        f"THEN {c} END AS {v}")
        y = f"CAST({spec.column(spec.target)} AS VARCHAR) AS y_true"
        return (f"{name} AS (SELECT {spec.key}, {', '.join(cols + [y])} FROM {source}"
                + (f" WHERE {where})" if where else ")"))

    def posterior(self, ev_vars: list[str], query: str | None = None, ev: str = "ev",
                  name: str = "post") -> list[str]:
        """Brute force: distinct evidence rows x full hidden grid x all factors."""
        spec = self.spec
        q = query or spec.target
        ev_vars = [v for v in ev_vars if v != q]
        evl = ", ".join(ev_vars)
        dev = f"dev AS (SELECT DISTINCT {evl} FROM {ev})" if ev_vars else \
            "dev AS (SELECT 1 AS _one)"
        joins = []
        for v in spec.names:
            if v in ev_vars:
                joins.append(f"JOIN domains x_{v} ON x_{v}.node = {sq(v)} AND "
                             f"(dev.{v} IS NULL OR x_{v}.value = dev.{v})")
            else:
                joins.append(f"JOIN domains x_{v} ON x_{v}.node = {sq(v)}")
        for n in spec.nodes:
            on = [f"f_{n.name}.node = {sq(n.name)}", f"f_{n.name}.value = x_{n.name}.value"] + \
                 [f"f_{n.name}.pa{i + 1} = x_{p}.value" for i, p in enumerate(n.parents)]
            joins.append(f"JOIN factors f_{n.name} ON " + " AND ".join(on))
        w = " * ".join(f"f_{n}.p" for n in spec.names)
        dsel = ", ".join(f"dev.{v}" for v in ev_vars)
        grp = (dsel + ", ") if ev_vars else ""
        joint = f"""joint AS (
          SELECT {grp}x_{q}.value AS class, x_{q}.ord AS class_ord, sum({w}) AS w
          FROM dev {' '.join(joins)} GROUP BY {grp}x_{q}.value, x_{q}.ord)"""
        part = f"PARTITION BY {evl}" if ev_vars else ""
        ncls = f"(SELECT count(*) FROM domains WHERE node = {sq(q)})"
        norm = f"""jpost AS (
          SELECT {evl + ', ' if ev_vars else ''}class, class_ord,
                 CASE WHEN sum(w) OVER ({part}) > 0 THEN w / sum(w) OVER ({part})
                      ELSE 1.0 / {ncls} END AS p
          FROM joint)"""
        on = " AND ".join(f"e.{v} IS NOT DISTINCT FROM j.{v}" for v in ev_vars) or "TRUE"
        fin = f"""{name} AS (SELECT e.{spec.key}, e.y_true, j.class, CAST(j.class_ord AS INTEGER) AS class_ord, j.p
                  FROM {ev} e JOIN jpost j ON {on})"""
        return [dev, joint, norm, fin]

    # -- sampling (I7-I9) ----------------------------------------------------
    def cumulative(self) -> str:
        part = ", ".join(["node"] + self.pas)
        return f"""cum AS (SELECT node, {', '.join(self.pas)}, value, ord, p,
              sum(p) OVER (PARTITION BY {part} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_hi,
              ord = max(ord) OVER (PARTITION BY {part}) AS is_last
            FROM factors)"""

    def _join_cum(self, node: str, alias: str = "c") -> str:
        n = self.spec.node(node)
        on = [f"{alias}.node = {sq(node)}"] + [f"{alias}.pa{i + 1} = s.{p}" for i, p in enumerate(n.parents)]
        return " AND ".join(on)

    def samples(self, n: int, seed: int, name: str = "samples") -> list[str]:
        from bnlake.functions.scalar import sql_uniform
        out = [self.cumulative(), f"s_0 AS (SELECT range AS sample_id FROM range(0, {n}))"]
        done = []
        for i, v in enumerate(self.spec.names):
            u = sql_uniform(str(seed), "s.sample_id", sq(v))
            sel = ", ".join(["s.sample_id"] + [f"s.{x}" for x in done] + [f"c.value AS {v}"])
            out.append(f"""s_{i + 1} AS (SELECT {sel} FROM s_{i} s JOIN cum c ON {self._join_cum(v)}
                 AND {u} >= c.cum_hi - c.p AND ({u} < c.cum_hi OR c.is_last))""")
            done.append(v)
        out.append(f"{name} AS (SELECT * FROM s_{len(self.spec.names)})")
        return out

    def lw(self, ev_vars: list[str], n: int, seed: int, ev: str = "ev") -> list[str]:
        """Weighted samples lw_s(eid, sample_id, vars..., w) and lw_cases(key, eid)."""
        from bnlake.functions.scalar import sql_uniform
        eid = "md5(" + " || '|' || ".join(f"coalesce(length({v}) || ':' || {v}, '-')" for v in ev_vars) + ")"
        es = ", ".join(f"{v} AS e_{v}" for v in ev_vars)
        out = [self.cumulative() if "cum AS" not in "" else "",
               f"lw_cfg AS (SELECT DISTINCT {', '.join(ev_vars)}, {eid} AS eid FROM {ev})",
               f"lw_cases AS (SELECT {self.spec.key}, {eid} AS eid FROM {ev})",
               f"lw_0 AS (SELECT eid, {es}, r.range AS sample_id, 1.0 AS w FROM lw_cfg, range(0, {n}) r)"]
        done = []
        carry = ["s.eid"] + [f"s.e_{v}" for v in ev_vars] + ["s.sample_id"]
        for i, v in enumerate(self.spec.names):
            u = sql_uniform(str(seed), "s.eid", "s.sample_id", sq(v))
            drawn = f"({u} >= c.cum_hi - c.p AND ({u} < c.cum_hi OR c.is_last))"
            if v in ev_vars:
                cond = f"CASE WHEN s.e_{v} IS NOT NULL THEN c.value = s.e_{v} ELSE {drawn} END"
                w = f"s.w * CASE WHEN s.e_{v} IS NOT NULL THEN c.p ELSE 1.0 END AS w"
            else:
                cond, w = drawn, "s.w AS w"
            sel = ", ".join(carry + [f"s.{x}" for x in done] + [f"c.value AS {v}", w])
            out.append(f"lw_{i + 1} AS (SELECT {sel} FROM lw_{i} s JOIN cum c ON {self._join_cum(v)} AND {cond})")
            done.append(v)
        out.append(f"lw_s AS (SELECT * FROM lw_{len(self.spec.names)})")
        return [c for c in out if c]

    def lw_post(self, n: int, name: str, query: str | None = None) -> str:
        q = query or self.spec.target
        ncls = f"(SELECT count(*) FROM domains WHERE node = {sq(q)})"
        return f"""{name} AS (SELECT lc.{self.spec.key}, a.class, CAST(dd.ord AS INTEGER) AS class_ord, a.p
            FROM (SELECT eid, class, CASE WHEN sum(w) OVER (PARTITION BY eid) > 0
                                          THEN w / sum(w) OVER (PARTITION BY eid) ELSE 1.0 / {ncls} END AS p
                  FROM (SELECT eid, {q} AS class, sum(w) AS w FROM lw_s WHERE sample_id < {n} GROUP BY 1, 2)) a
            JOIN domains dd ON dd.node = {sq(q)} AND dd.value = a.class
            JOIN lw_cases lc ON lc.eid = a.eid)"""
