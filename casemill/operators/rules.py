"""Rule tables: rule trees flattened to rows, and checks over many rule sets."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.lineage import settle

def _tree(rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves and inner nodes of rule trees; each level of nesting is one lateral explode, as long as any rule has a deeper one."""
    v = rules.select("set_id", "rule", F.try_parse_json("rule_json").alias("v"))
    arr = lambda n, p: F.try_variant_get(n, p, "array<variant>")
    tops = [v.select("set_id", "rule", F.lit(s).alias("side"), F.posexplode(arr("v", f"$.{s}")).alias("p", "node")).select("set_id", "rule", "side", F.col("p").cast("string").alias("path"), "node", F.lit(False).alias("neg"), F.lit(False).alias("in_or")) for s in ("if", "then")]
    level = reduce(DataFrame.unionByName, tops)
    leaves, inner = [], []
    kind = F.when(arr("node", "$.and").isNotNull(), "and").when(arr("node", "$.or").isNotNull(), "or").when(F.try_variant_get("node", "$.not", "variant").isNotNull(), "not")
    while True:
        leaves.append(level.filter(kind.isNull()))
        kids = F.coalesce(arr("node", "$.and"), arr("node", "$.or"), F.array(F.try_variant_get("node", "$.not", "variant")))
        here = level.filter(kind.isNotNull()).withColumn("kind", kind)
        inner.append(here.select("set_id", "rule", "side", "path", "kind", "neg"))
        level = here.select("set_id", "rule", "side", "path", F.posexplode(kids).alias("p", "kid"), (F.col("neg") != (F.col("kind") == "not")).alias("neg"), (F.col("in_or") | (F.col("kind") == "or")).alias("in_or"))
        level = level.select("set_id", "rule", "side", F.concat_ws(".", "path", F.col("p").cast("string")).alias("path"), F.col("kid").alias("node"), "neg", "in_or")
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, leaves), reduce(DataFrame.unionByName, inner)


def rule_nodes(rules: DataFrame) -> DataFrame:
    """rules(set_id, rule, rule_json) to leaves: side, path, kind (atom, compare), parts, negated.

    Negation is inherited. A literal on the left of a compare is read from the right.
    """
    return _leaf_columns(_tree(rules)[0])


def _leaf_columns(n: DataFrame) -> DataFrame:
    get = lambda p, t="string": F.try_variant_get("node", p, t)
    turned = get("$.compare.right.func").isNotNull() & get("$.compare.left.func").isNull()
    op = get("$.compare.op")
    op = F.when(~turned, op).when(op.startswith(">"), F.concat(F.lit("<"), F.substring(op, 2, 1))).when(op == "=<", ">=").when(op.isin("<", "<="), F.concat(F.lit(">"), F.substring(op, 2, 1))).otherwise(op)
    kind = F.when(get("$.compare", "variant").isNotNull(), "compare").when(get("$.pred").isNotNull(), "atom").otherwise("unreadable")
    symbol = F.coalesce(get("$.pred"), get("$.compare.left.func"), get("$.compare.right.func"))
    args = F.coalesce(get("$.args", "array<string>"), get("$.compare.left.args", "array<string>"), get("$.compare.right.args", "array<string>"))
    return n.select("set_id", "rule", "side", "path", kind.alias("kind"), symbol.alias("symbol"), args.alias("args"), (F.col("neg") != F.coalesce(get("$.negated", "boolean"), F.lit(False))).alias("negated"), op.alias("op"), F.when(turned, get("$.compare.left")).otherwise(get("$.compare.right")).alias("literal"), "in_or")


def rule_atoms(rules: DataFrame) -> DataFrame:
    """Atoms of rules."""
    return rule_nodes(rules).filter("kind = 'atom'").select("set_id", "rule", "side", "path", "symbol", "args", "negated")


def rule_compares(rules: DataFrame) -> DataFrame:
    """Compares of rules, operators in one spelling."""
    op = F.when(F.col("op") == "=<", "<=").when(F.col("op") == "==", "=").when(F.col("op").isin("<>", "~="), "!=").otherwise(F.col("op"))
    return rule_nodes(rules).filter("kind = 'compare'").select("set_id", "rule", "side", "path", F.col("symbol").alias("func"), op.alias("op"), F.col("literal").try_cast("double").alias("literal"))


def or_shapes(rules: DataFrame) -> DataFrame:
    """OR nodes in IFs by what they join: exceeded or within (single compares of that kind only), pairwise (ANDs of two compares
    and more), other; with their sign and whether a NOT stands right above them."""
    leaves, inner = _tree(rules)
    up = F.regexp_replace("path", r"\.?[0-9]+$", "")
    key = ["set_id", "rule", "parent"]
    kind = F.when(F.col("op").isin(">", ">="), "exceeded").when(F.col("op").isin("<", "<=", "=<"), "within")
    single = F.when((F.col("kind") == "compare") & F.col("literal").try_cast("double").isNotNull(), kind)
    at_leaf = _leaf_columns(leaves).filter("side = 'if'").select("set_id", "rule", up.alias("parent"), F.coalesce(single, F.lit("other")).alias("what"))
    nodes = inner.filter("side = 'if'").select("set_id", "rule", "path", up.alias("parent"), "kind", "neg")
    compares = at_leaf.filter("what <> 'other'").groupBy("set_id", "rule", F.col("parent").alias("path")).agg(F.count("*").alias("n_compares"))
    at_inner = nodes.join(compares, ["set_id", "rule", "path"], "left").select(*key, F.when((F.col("kind") == "and") & (F.col("n_compares") >= 2), "pair").otherwise("other").alias("what"))
    kids = at_leaf.unionByName(at_inner).groupBy(*key).agg(F.count("*").alias("n_kids"), F.count_distinct("what").alias("n_kinds"), F.min("what").alias("what")).withColumnRenamed("parent", "path")
    shape = F.when((F.col("n_kinds") > 1) | (F.col("n_kids") < 2), "other").when(F.col("what") == "pair", "pairwise").otherwise(F.col("what"))
    above = nodes.filter("kind = 'not'").select("set_id", "rule", F.col("path").alias("parent"), F.lit(True).alias("under_not"))
    x = nodes.filter("kind = 'or'").join(kids, ["set_id", "rule", "path"], "left").join(above, key, "left")
    return x.select("set_id", "rule", "path", F.coalesce(shape, F.lit("other")).alias("shape"), F.col("neg").alias("negated"), F.coalesce("under_not", F.lit(False)).alias("under_not"))


def dependency_edges(atoms: DataFrame) -> DataFrame:
    """Which symbols a defined symbol uses: (set_id, defined, used)."""
    then = atoms.filter("side = 'then'").select("set_id", "rule", F.col("symbol").alias("defined"))
    return then.join(atoms.filter("side = 'if'").select("set_id", "rule", F.col("symbol").alias("used")), ["set_id", "rule"]).select("set_id", "defined", "used").distinct()


def closure(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """D3: edges(src, dst), targets(target) -> (target, node, depth): everything reachable, semi-naive.

    Only the nodes found last are joined with the edges again; each round is written to the shared folder.
    """
    known = settle(targets.select("target", F.col("target").alias("node"), F.lit(0).alias("depth")).distinct())
    new = known
    for d in count(1):
        step = new.join(edges, new.node == edges.src).select("target", F.col("dst").alias("node")).distinct()
        new = settle(step.join(known.select("target", "node"), ["target", "node"], "left_anti").withColumn("depth", F.lit(d)))
        if new.isEmpty():
            break
        known = known.unionByName(new)
    return known


def floating_helpers(atoms: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = ("helper",)) -> DataFrame:
    """Symbols of the given kinds used in an IF and defined in no THEN."""
    own = symbols.filter(F.col("kind").isin(*kinds)).select("set_id", F.col("name").alias("symbol"))
    used = atoms.filter("side = 'if'").groupBy("set_id", "symbol").agg(F.count_distinct("rule").alias("n_rules"))
    return used.join(own, ["set_id", "symbol"], "left_semi").join(atoms.filter("side = 'then'").select("set_id", "symbol"), ["set_id", "symbol"], "left_anti")


def strong_components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) -> node, component: strongly connected components by trimming and colouring; components are named by a node of theirs.

    Nodes without an edge in or out among those left are components of their own and leave, until none does. Then the least name spreads
    forwards; what reaches its namesake backwards within one colour is that node's component, and leaves. Each round joins edges with one row
    a node, and is written to the shared folder; no pairs of nodes that reach each other are made.
    """
    left = settle(edges.select("src", "dst").distinct())
    found: list[DataFrame] = [left.select(F.col("src").alias("node")).union(left.select("dst")).distinct().withColumn("component", F.col("node"))]
    parts: list[DataFrame] = []
    left = left.filter("src <> dst")
    while True:
        while True:
            kept = settle(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
            if kept.count() == left.count():
                break
            left = kept
        if kept.isEmpty():
            break
        left = kept
        colour = settle(left.select(F.col("src").alias("node")).distinct().withColumn("colour", F.col("node")))
        fresh = colour
        while not fresh.isEmpty():
            offered = left.join(fresh.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("least"))
            better = settle(colour.join(offered, "node").filter("least < colour").select("node", F.col("least").alias("colour")))
            colour = settle(colour.join(better.withColumnRenamed("colour", "least"), "node", "left").select("node", F.coalesce("least", "colour").alias("colour")))
            fresh = better
        inside = left.join(colour.withColumnsRenamed({"node": "src", "colour": "c1"}), "src").join(colour.withColumnsRenamed({"node": "dst", "colour": "c2"}), "dst").filter("c1 = c2").select("src", "dst", F.col("c1").alias("colour"))
        inside = settle(inside)
        reached = fresh = settle(colour.filter("node = colour"))
        while not fresh.isEmpty():
            back = inside.join(fresh.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            fresh = settle(back.join(reached, ["node", "colour"], "left_anti"))
            reached = settle(reached.unionByName(fresh))
        parts.append(reached.withColumnRenamed("colour", "component"))
        gone = reached.select("node")
        left = settle(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    if not parts:
        return found[0]
    large = reduce(DataFrame.unionByName, parts)
    return found[0].join(large.withColumnRenamed("component", "larger"), "node", "left").select("node", F.coalesce("larger", "component").alias("component"))


def definition_cycles(edges: DataFrame) -> DataFrame:
    """Nodes of edges(src, dst) that reach themselves: those of components with several nodes, and those with an edge to themselves."""
    of = settle(strong_components(edges))
    many = of.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return of.join(many, "component", "left_semi").select(F.col("node").alias("target")).union(edges.filter("src = dst").select("src")).distinct()


def unsafe_negative_rules(atoms: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rules with a negated head and a negated observable in the body."""
    obs = symbols.filter("kind = 'observable'").select("set_id", F.col("name").alias("symbol"))
    head = atoms.filter("side = 'then' and negated").select("set_id", "rule").distinct()
    return head.join(atoms.filter("side = 'if' and negated").join(obs, ["set_id", "symbol"], "left_semi").groupBy("set_id", "rule").agg(F.count("*").alias("n_negated")), ["set_id", "rule"])


def threshold_provenance(compares: DataFrame, numbers: DataFrame) -> DataFrame:
    """Literals that the set's text doesn't hold; 0 to 5 and 10 are exempt, as are texts without numbers."""
    exempt = F.col("literal").between(0, 5) & (F.col("literal") == F.floor("literal")) | (F.col("literal") == 10)
    known = compares.filter(~exempt).join(numbers.select("set_id").distinct(), "set_id", "left_semi")
    return known.join(numbers.select("set_id", F.col("value").alias("literal")), ["set_id", "literal"], "left_anti")


def rule_arity(atoms: DataFrame, symbols: DataFrame) -> DataFrame:
    """Atoms with another number of arguments than declared, or of an undeclared symbol."""
    s = symbols.select("set_id", F.col("name").alias("symbol"), F.size("args").alias("arity"))
    x = atoms.join(s, ["set_id", "symbol"], "left")
    code = F.when(F.col("arity").isNull(), "undeclared").when(F.size(x["args"]) != F.col("arity"), "arity")
    return x.withColumn("code", code).filter("code is not null").select("set_id", "rule", "path", "symbol", "code")


def rule_types(rules: DataFrame, symbols: DataFrame) -> DataFrame:
    """What is wrong with the leaves of rules(set_id, rule, rule_json), one row per leaf, code and argument.

    undeclared, arity, function_as_predicate, predicate_as_function and unlike_sorts (a number compared with a function of
    another sort, or a text with a number) have argument -1; unbound (no quantifier names the argument) and sort (its
    quantifier has another type than declared) name the argument. Numbers are arguments of sort Int or Real.
    """
    s = symbols.select("set_id", F.col("name").alias("symbol"), F.col("args").alias("sorts"), "returns")
    bound = F.try_variant_get(F.try_parse_json("rule_json"), "$.forall", "array<struct<var:string,type:string>>")
    env = rules.select("set_id", "rule", F.coalesce(bound, F.array().cast("array<struct<var:string,type:string>>")).alias("env"))
    x = rule_nodes(rules).filter("kind <> 'unreadable'").join(s, ["set_id", "symbol"], "left").join(env, ["set_id", "rule"])
    numeric = F.col("returns").isin("Int", "Real")
    whole = (
        F.when(F.col("returns").isNull(), "undeclared")
        .when(F.coalesce(F.size("args"), F.lit(0)) != F.size("sorts"), "arity")
        .when((F.col("kind") == "atom") & (F.col("returns") != "Bool"), "function_as_predicate")
        .when((F.col("kind") == "compare") & (F.col("returns") == "Bool"), "predicate_as_function")
        .when((F.col("kind") == "compare") & (F.col("literal").try_cast("double").isNotNull() != numeric), "unlike_sorts")
    )
    key = ["set_id", "rule", "side", "path", "symbol"]
    by_leaf = x.select(*key, F.lit(-1).alias("arg"), whole.alias("code"))
    a = x.select(*key, "sorts", "env", F.posexplode("args").alias("arg", "name"))
    declared = F.try_element_at("sorts", F.col("arg") + 1)
    found = F.try_element_at(F.filter("env", lambda e: e["var"] == F.col("name")), F.lit(1))["type"]
    number = F.col("name").try_cast("double").isNotNull()
    own = F.when(number & F.col("name").try_cast("long").isNotNull(), F.when(declared == "Real", "Real").otherwise("Int")).when(number, "Real").otherwise(found)
    by_arg = a.select(*key, "arg", F.when(own.isNull(), "unbound").when(own != declared, "sort").alias("code"))
    return by_leaf.unionByName(by_arg).filter("code is not null")


def quarantine_rules(rules: DataFrame, violations: DataFrame) -> DataFrame:
    """Every rule with the first code against it, or valid."""
    first = violations.groupBy("set_id", "rule").agg(F.min("code").alias("code"))
    return rules.select("set_id", "rule").join(first, ["set_id", "rule"], "left").withColumn("status", F.when(F.col("code").isNull(), "valid").otherwise("quarantined"))


def coerce_literals(compares: DataFrame, symbols: DataFrame) -> DataFrame:
    """Literals in the sort of the function they are compared with, where nothing is lost."""
    s = symbols.select("set_id", F.col("name").alias("func"), "returns")
    whole = F.col("literal") == F.floor("literal")
    text = F.when((F.col("returns") == "Int") & whole, F.col("literal").cast("long").cast("string")).when(F.col("returns") == "Real", F.format_string("%.1f", "literal"))
    return compares.join(s, ["set_id", "func"], "left").select("set_id", "rule", "func", text.alias("coerced"), (text.isNull()).alias("lossy"))
