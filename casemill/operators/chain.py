"""Rules as rows: whole rule tables evaluated by a fixed number of joins, however many sets and rules they hold.

A rule's IF tree is compiled to clauses (conjunctions); an OR node becomes a symbol of its own (``#rule.place``) that each of its
alternatives concludes, so that clauses grow with the tree and not with its combinations. Evaluation carries partial bindings (a map
of variables) through the literals of all clauses at once: step k is one equi join of the bindings with the facts on set, case,
symbol and the arguments that are bound by then, which the clause knows beforehand.

Rounds are semi-naive: after the first round of a stratum each literal in turn is matched with what the last round added, and only the rest
with everything, so that the bindings that are made, joined and written fall with the delta. Strata come from the
dependencies between symbols: negation of a closed symbol is tried when the symbol is finished; a cycle through
such a negation is an error.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.lineage import settle
from casemill.operators.rules import strong_components

#: Operators read from the other side, and in one spelling.
TURNED = {">": "<", ">=": "<=", "<": ">", "<=": ">=", "=": "=", "!=": "!="}
SPELLED = {"=<": "<=", "==": "=", "<>": "!=", "~=": "!="}
STEP = "symbol string, args array<string>, polarity boolean, op string, literal string, closed boolean, bound array<int>, new array<struct<var:string,pos:int>>, same array<struct<pos:int,first:int>>"
CLAUSE = f"clause string, variant int, head string, head_args array<string>, head_polarity boolean, steps array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in STEP.split(', ')))}>>"
CLAUSES = f"error string, clauses array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ', 1) for x in CLAUSE.split(', ', 5)))}>>"
PREMISE = "struct<symbol:string,args:array<string>,polarity:boolean,value:string>"
ATOM = ["set_id", "case_id", "world", "symbol", "args", "polarity"]
LITERAL = ["set_id", "case_id", "symbol", "args", "polarity"]
SEP = "\x01"


def _term(t: object) -> str:
    return str(t["var"]) if isinstance(t, dict) else str(t)


def _number(t: str) -> bool:
    try:
        float(t)
    except ValueError:
        return False
    return True


def _tree(node: dict, negated: bool = False) -> tuple[str, list]:
    """and, or or leaf, with negation pushed down; raises ValueError on a node that is none of and, or, not, pred, compare."""
    for kind, turned in (("and", "or"), ("or", "and")):
        if kind in node:
            return (turned if negated else kind), [_tree(n, negated) for n in node[kind]]
    if "not" in node:
        return _tree(node["not"], not negated)
    negated = bool(node.get("negated")) != negated
    if "compare" in node:
        c = node["compare"]
        left, op, right = c["left"], SPELLED.get(c["op"], c["op"]), c["right"]
        if isinstance(right, dict) and not isinstance(left, dict):
            left, op, right = right, TURNED[op], left
        if isinstance(right, dict) or op not in TURNED:
            raise ValueError(f"unsupported compare: {op}")
        return "leaf", [{"symbol": left["func"], "args": [_term(a) for a in left["args"]], "polarity": not negated, "op": op, "literal": str(right)}]
    if "pred" in node:
        return "leaf", [{"symbol": node["pred"], "args": [_term(a) for a in node.get("args") or []], "polarity": not negated, "op": None, "literal": None}]
    raise ValueError(f"unsupported IF node: {sorted(node)}")


def _names(tree: tuple[str, list]) -> set[str]:
    kind, parts = tree
    return set(parts[0]["args"]) if kind == "leaf" else set().union(*map(_names, parts)) if parts else set()


def _steps(body: list[dict], first: int, variables: set[str], closed: Iterable[str]) -> list[dict]:
    """The literals in the order of matching: ``first``, then what shares a bound variable, closed negations at the end."""
    known: set[str] = set()
    out = []

    def add(x: dict, is_closed: bool) -> None:
        bound, new, same, at = [], [], [], {}
        for i, a in enumerate(x["args"]):
            if a not in variables or a in known:
                bound.append(i)
            elif a in at:
                same.append({"pos": i, "first": at[a]})
            else:
                at[a] = i
                new.append({"var": a, "pos": i})
        if is_closed and new:
            raise ValueError(f"nothing binds {new[0]['var']}")
        out.append(x | {"closed": is_closed, "bound": bound, "new": new, "same": same})
        known.update(at)

    last = [x for x in body if x["op"] is None and not x["polarity"] and x["symbol"] in closed]
    rest = [x for x in body if x not in last]
    if not rest:
        raise ValueError("nothing but closed negations")
    add(rest.pop(first), False)
    while rest:
        k = max(range(len(rest)), key=lambda i: (sum(a in known or a not in variables for a in rest[i]["args"]), -i))
        add(rest.pop(k), False)
    for x in last:
        add(x, True)
    return out


def compile_rule(rule: int, text: str, closed: Iterable[str]) -> dict:
    """Clauses of a rule, each once for every literal that can be matched first, or what is wrong with it."""
    out: list[dict] = []
    try:
        t = json.loads(text)
        heads = [h["not"] | {"negated": not h["not"].get("negated")} if "not" in h else h for h in t["then"]]
        heads = [(h["pred"], [_term(a) for a in h.get("args") or []], not h.get("negated", False)) for h in heads]
        tree = _tree({"and": t["if"]})
        every = _names(tree).union(*(h[1] for h in heads))
        named = {str(q["var"]) for q in t["forall"]} if t.get("forall") else {a for a in every if not _number(a)}
        variables = every & named

        is_closed = lambda x: x["op"] is None and not x["polarity"] and x["symbol"] in closed

        def clause(name: str, heads: list[tuple], tree: tuple[str, list], needed: set[str], around: list[dict]) -> None:
            parts = tree[1] if tree[0] == "and" else [tree]
            flat: list = []
            while parts:
                flat = [q for p in parts for q in (p[1] if p[0] == "and" else [p])]
                if flat == parts:
                    break
                parts = flat
            body = []
            leaves = [p[1][0] for p in flat if p[0] == "leaf"]
            inside = around + [x for x in leaves if not is_closed(x)]
            for i, p in enumerate(flat):
                if p[0] == "leaf":
                    body.append(p[1][0])
                    continue
                args = sorted(_names(p) & variables & needed.union(*(_names(q) for j, q in enumerate(flat) if j != i)))
                own = f"#{rule}.{name}{i}"
                body.append({"symbol": own, "args": args, "polarity": True, "op": None, "literal": None})
                for j, q in enumerate(p[1]):
                    clause(f"{name}{i}.{j}.", [(own, args, True)], q, set(args), inside)
            bound = {a for x in body if not is_closed(x) for a in x["args"]}
            if around and not (bound and variables & needed.union(*(x["args"] for x in body)) <= bound):
                body = around + body  # an alternative that binds too little itself: what stands beside the OR does
            n = sum(not is_closed(x) for x in body)
            for variant in range(max(n, 1)):
                steps = _steps(body, variant, variables, closed)
                found = {x["var"] for s in steps for x in s["new"]}
                for symbol, args, polarity in heads:
                    if loose := sorted(set(args) & variables - found):
                        raise ValueError(f"nothing binds {loose[0]}")
                    out.append({"clause": name or ".", "variant": variant, "head": symbol, "head_args": args, "head_polarity": polarity, "steps": steps})

        clause("", heads, tree, {a for h in heads for a in h[1]}, [])
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        return {"error": f"{type(e).__name__}: {e}", "clauses": []}
    return {"error": None, "clauses": out}


def compile_rules(rules: DataFrame, closed: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """rules(set_id, rule, rule_json) -> clauses (set_id, rule and CLAUSE) and what can't be read (set_id, rule, reason)."""
    names = frozenset(closed)
    work = F.udf(lambda rule, text: compile_rule(rule, text, names), CLAUSES)
    x = settle(rules.select("set_id", "rule", work("rule", "rule_json").alias("c")))
    return x.select("set_id", "rule", F.inline("c.clauses")), x.filter("c.error is not null").select("set_id", "rule", F.col("c.error").alias("reason"))


def _check_cycles(edges: DataFrame) -> None:
    """Raises where a negative edge joins two symbols of one strong component."""
    node = lambda c: F.struct("set_id", F.col(c).alias("symbol"))
    of = strong_components(edges.select(node("src").alias("src"), node("dst").alias("dst")))
    a, b = (of.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")) for c in ("src", "dst"))
    bad = edges.filter("neg = 1").select("set_id", node("src").alias("src"), node("dst").alias("dst")).join(a, "src").join(b, "dst").filter("c_src = c_dst").select("set_id", "src.symbol").first()
    if bad:
        raise ValueError(f"closed negation of {bad['symbol']} depends on itself in set {bad['set_id']}")


def strata(clauses: DataFrame) -> DataFrame | None:
    """clauses -> set_id, symbol, stratum of every concluded symbol, None where all are of stratum 0; raises where a closed negation
    is part of a cycle. Only negations of symbols that some rule concludes count."""
    heads = clauses.select("set_id", F.col("head").alias("symbol")).distinct()
    body = clauses.filter("variant = 0").select("set_id", F.col("head").alias("dst"), F.explode("steps").alias("s"))
    edges = body.select("set_id", "dst", F.col("s.symbol").alias("src"), F.col("s.closed").cast("int").alias("neg")).groupBy("set_id", "src", "dst").agg(F.max("neg").alias("neg"))
    edges = settle(edges.join(heads.withColumnRenamed("symbol", "src"), ["set_id", "src"], "left_semi"))
    if edges.filter("neg = 1").isEmpty():
        return None
    level = settle(heads.withColumn("stratum", F.lit(0)))
    for k in count(1):
        if k == 8:  # deep, or endless
            _check_cycles(edges)
        up = edges.join(level.withColumnRenamed("symbol", "src"), ["set_id", "src"]).groupBy("set_id", F.col("dst").alias("symbol")).agg(F.max(F.col("stratum") + F.col("neg")).alias("up"))
        new = settle(level.join(up, ["set_id", "symbol"], "left").select("set_id", "symbol", F.greatest("stratum", F.coalesce("up", F.lit(0))).alias("stratum")))
        if new.agg(F.sum("stratum")).first() == level.agg(F.sum("stratum")).first():
            return new
        level = new


def _keyed(known: DataFrame, patterns: DataFrame) -> DataFrame:
    """Facts once for each way in which clauses look their symbol up: on, the looked-up arguments as one text."""
    x = known.withColumn("n", F.size("args")).join(patterns, ["set_id", "symbol", "n"])
    return x.selectExpr("set_id", "case_id", "world", "symbol", "n", "bound", f"array_join(transform(bound, i -> get(args, i)), '{SEP}') as on", "args as f_args", "polarity as f_polarity", "value")


#: What else is asked of a matched fact: equal arguments where the literal repeats a variable, and its sign, or its value compared.
HOLDS = """forall(step.same, s -> get(f_args, s.pos) = get(f_args, s.first)) and coalesce(
 case when step.op is null then value is null and f_polarity = step.polarity
 else case when try_cast(step.literal as double) is null then case step.op when '=' then value = step.literal when '!=' then value <> step.literal end
  else case step.op when '>' then try_cast(value as double) > try_cast(step.literal as double) when '>=' then try_cast(value as double) >= try_cast(step.literal as double)
   when '<' then try_cast(value as double) < try_cast(step.literal as double) when '<=' then try_cast(value as double) <= try_cast(step.literal as double)
   when '=' then try_cast(value as double) = try_cast(step.literal as double) else try_cast(value as double) <> try_cast(step.literal as double) end end = step.polarity end, false)"""
BOUND = "map_concat(b, map_from_arrays(transform(step.new, p -> p.var), transform(step.new, p -> get(f_args, p.pos)))) as b"
PREMISES = "concat(premises, array(struct(step.symbol as symbol, f_args as args, f_polarity as polarity, value))) as premises"
RESOLVED = "transform({}, a -> coalesce(try_element_at(b, a), a))"
LOOKED_UP = f"array_join(transform(step.bound, i -> get({RESOLVED.format('step.args')}, i)), '{SEP}')"


def _matched(x: DataFrame) -> DataFrame:
    """Bindings and premises with the matched fact of the current step; the step is done."""
    return x.filter(HOLDS).selectExpr(*STATE, "world", "steps", BOUND, PREMISES)


STATE = ["set_id", "case_id", "rule", "clause", "head", "head_args", "head_polarity"]


def fire(clauses: DataFrame, delta: DataFrame, stores: list[DataFrame], held: DataFrame | None, shapes: set[tuple[int, int]]) -> DataFrame:
    """Derivations (ATOM, rule, clause, premises) whose first literal is matched by ``delta`` and the others by any of ``stores``.

    Facts of world "" belong to all worlds; ``held`` are the closed atoms that a negation meets, for all worlds. Each of ``shapes``, the
    numbers of open and closed literals that clauses have, is one chain of joins.
    """
    facts = delta.selectExpr("set_id", "case_id", "world", "symbol", "size(args) as n", "args as f_args", "polarity as f_polarity", "value")
    nothing = ("map_from_arrays(cast(array() as array<string>), cast(array() as array<string>)) as b", f"cast(array() as array<{PREMISE}>) as premises")
    out = []
    for n_open, n_closed in sorted(shapes):
        own = clauses.filter(f"n_open = {n_open} and n_closed = {n_closed}").withColumn("step", F.expr("get(steps, 0)"))
        own = own.selectExpr("set_id", *STATE[2:], "steps", "step", "step.symbol as symbol", "size(step.args) as n")
        x = facts.join(own, ["set_id", "symbol", "n"]).filter("forall(step.bound, i -> get(f_args, i) = get(step.args, i))")
        live = _matched(x.selectExpr("*", *nothing))
        for k in range(1, n_open + n_closed):
            live = live.withColumn("step", F.expr(f"get(steps, {k})"))
            if k < n_open:
                keyed = live.selectExpr("*", "step.symbol as symbol", "size(step.args) as n", "step.bound as bound", f"{LOOKED_UP} as on")
                fits = [_matched(keyed.join(s.withColumnRenamed("world", "f_world"), ["set_id", "case_id", "symbol", "n", "bound", "on"]).filter("f_world = '' or f_world = world")) for s in stores]
                live = reduce(DataFrame.unionByName, fits)
            else:
                free = live.selectExpr("*", "step.symbol as symbol", f"{RESOLVED.format('step.args')} as args").join(held, ["set_id", "case_id", "symbol", "args"], "left_anti")
                live = free.selectExpr(*STATE, "world", "steps", "b", "concat(premises, array(struct(symbol, args, false as polarity, cast(null as string) as value))) as premises")
            if k % 5 == 0:  # else plans would grow with the rules
                live = settle(live)
        out.append(live)
    done = reduce(DataFrame.unionByName, out)
    return done.selectExpr("set_id", "case_id", "world", "head as symbol", f"{RESOLVED.format('head_args')} as args", "head_polarity as polarity", "rule", "clause", "array_sort(premises) as premises").distinct()


@dataclass
class Closure:
    """atoms: ATOM, value, rule, round; derivations: ATOM, rule, clause, premises, every way in which an atom was concluded."""

    atoms: DataFrame
    derivations: DataFrame


class Program:
    """A rule table, compiled and stratified."""

    def __init__(self, rules: DataFrame, closed: Iterable[str] = ()):
        self.closed = frozenset(closed)
        clauses, bad = compile_rules(rules, self.closed)
        if found := bad.limit(10).collect():
            raise ValueError(f"rules that can't be read: {[tuple(r) for r in found]}")
        closed_steps = F.size(F.filter("steps", lambda s: s["closed"]))
        clauses = clauses.withColumns({"n_open": F.size("steps") - closed_steps, "n_closed": closed_steps})
        #: One row for each stratum and number of open and closed literals.
        shapes = clauses.select(F.lit(0).alias("stratum"), "n_open", "n_closed").distinct().collect()
        self.negates = any(r["n_closed"] for r in shapes)
        self.clauses = clauses.withColumn("stratum", F.lit(0))
        level = strata(clauses) if self.negates else None
        if level is not None:
            self.clauses = settle(clauses.join(level.withColumnRenamed("symbol", "head"), ["set_id", "head"]))
            shapes = self.clauses.select("stratum", "n_open", "n_closed").distinct().collect()
        self.shapes = {s: {(r["n_open"], r["n_closed"]) for r in shapes if r["stratum"] == s} for s in sorted({r["stratum"] for r in shapes})}
        # the first literal of a clause is matched by what is new; only the others are looked up
        step = self.clauses.select("set_id", "variant", F.explode(F.expr("slice(steps, 2, size(steps))")).alias("s")).filter("not s.closed")
        self.patterns = settle(step.groupBy("set_id", "s.symbol", F.size("s.args").alias("n"), "s.bound").agg((F.min("variant") == 0).alias("whole")))

    def held(self, atoms: DataFrame) -> DataFrame | None:
        """Atoms of closed symbols that are held and not denied: their negations fail."""
        if not self.negates:
            return None
        own = atoms.filter(F.col("symbol").isin(*self.closed) & F.col("value").isNull())
        return own.groupBy("set_id", "case_id", "symbol", "args").agg(F.bool_or("polarity").alias("p"), F.bool_or(~F.col("polarity")).alias("d")).filter("p and not d").drop("p", "d")

    def run(self, facts: DataFrame) -> Closure:
        """facts(set_id, case_id, symbol, args, polarity, value) and everything that the rules of their set conclude."""
        own = facts.select("set_id", "case_id", F.lit("").alias("world"), "symbol", "args", "polarity", "value").distinct()
        known = settle(own.withColumns({"rule": F.lit(None).cast("int"), "round": F.lit(0)}))
        return self._rounds(known, None, list(self.shapes))

    def assume(self, base: Closure, worlds: DataFrame) -> Closure:
        """worlds(set_id, case_id, world, symbol, args, polarity): what follows in each world from its atoms and the case's closure, and isn't
        in the closure. Closed symbols stay as the base has them."""
        own = worlds.select(*ATOM).distinct().join(base.atoms.filter("value is null").select(*LITERAL), LITERAL, "left_anti")
        new = settle(own.select(*ATOM, F.lit(None).cast("string").alias("value"), F.lit(None).cast("int").alias("rule"), F.lit(0).alias("round")))
        return self._rounds(new, base.atoms, [None])

    def _rounds(self, known: DataFrame, base: DataFrame | None, levels: list[int | None]) -> Closure:
        """Levels one after the other, each until a round adds nothing; level None: the clauses of all strata."""
        rounds = count(1)
        derived: list[DataFrame] = []
        shared = [] if base is None else [settle(_keyed(base, self.patterns))]
        for s in levels:
            clauses = self.clauses if s is None else self.clauses.filter(F.col("stratum") == s)
            shapes = set().union(*self.shapes.values()) if s is None else self.shapes[s]
            held = self.held(known if base is None else base)
            # everything is new to a stratum: one order of matching is enough
            delta, variants = known, clauses if s is None else clauses.filter("variant = 0")
            patterns = self.patterns if s is None else self.patterns.filter("whole")
            while True:
                k = next(rounds)
                found = settle(fire(variants, delta, [*shared, _keyed(known, patterns)], held, shapes))
                new = found.groupBy(*ATOM).agg(F.min("rule").alias("rule")).join(known.filter("value is null").select(*ATOM), ATOM, "left_anti")
                if base is not None:
                    new = new.join(base.filter("value is null").select(*LITERAL), LITERAL, "left_anti")
                new = settle(new.select(*ATOM, F.lit(None).cast("string").alias("value"), "rule", F.lit(k).alias("round")))
                derived.append(found)
                if new.isEmpty():
                    break
                known = known.unionByName(new)
                if k % 8 == 0:  # else plans would grow with the rounds
                    known, derived = settle(known), [settle(reduce(DataFrame.unionByName, derived).distinct())]
                delta, variants, patterns = new, clauses, self.patterns
        if not derived:
            derived = [known.limit(0).select(*ATOM, F.col("rule"), F.lit("").alias("clause"), F.array().cast(f"array<{PREMISE}>").alias("premises"))]
        return Closure(known, reduce(DataFrame.unionByName, derived).distinct())


def support(derivations: DataFrame, roots: DataFrame) -> DataFrame:
    """roots(root, LITERAL) -> root, LITERAL, depth: every atom that some derivation of a root rests on, backwards to the stated facts.

    Only what a round reached first is joined with the derivations again.
    """
    premise = derivations.select(*LITERAL, F.explode("premises").alias("p")).select(*LITERAL, F.col("p.symbol").alias("p_symbol"), F.col("p.args").alias("p_args"), F.col("p.polarity").alias("p_polarity"), F.col("p.value").alias("p_value")).distinct()
    premise = settle(premise)
    new = known = settle(roots.select("root", *LITERAL, F.lit(None).cast("string").alias("value"), F.lit(0).alias("depth")).distinct())
    for d in count(1):
        step = new.filter("value is null").join(premise, LITERAL).select("root", "set_id", "case_id", F.col("p_symbol").alias("symbol"), F.col("p_args").alias("args"), F.col("p_polarity").alias("polarity"), F.col("p_value").alias("value")).distinct()
        seen = known.select("root", "set_id", "case_id", *(F.col(c).alias(f"k_{c}") for c in ("symbol", "args", "polarity", "value")))
        same = [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in ("symbol", "args", "polarity", "value")]
        on = [step["root"] == seen["root"], step["set_id"] == seen["set_id"], step["case_id"] == seen["case_id"], *same]
        new = settle(step.join(seen, on, "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            return known
        known = known.unionByName(new)
