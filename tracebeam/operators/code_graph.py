"""Code graph: call resolution, edges, neighbours, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracebeam.operators.skew import first_per_key, pair_join
from tracebeam.operators.tables import replace_scopes
from tracebeam.session import materialize

# Names of the resolution strategies.
EXACT, SELF_METHOD, IMPORT_ALIAS = "exact", "self_method", "import_alias"
IMPORT_MEMBER, SAME_MODULE, UNRESOLVED = "import_member", "same_module", "<unresolved>"


def _entries(imports: Column, aliases: bool) -> Column:
    """(name, target) pairs an import list brings into scope, in order of appearance."""

    def of_one(imp: Column) -> Column:
        module = F.coalesce(imp["module"], F.lit(""))
        names = F.coalesce(imp["names"], F.array().cast("array<string>"))
        renamed = F.map_entries(
            F.coalesce(imp["alias_of"], F.create_map().cast("map<string,string>"))
        )
        pair = lambda name, target: F.struct(name.alias("name"), target.alias("target"))
        dotted = lambda name: F.concat(module, F.lit("."), name)
        if aliases:
            plain = F.array(
                pair(F.substring_index(module, ".", -1), module), pair(module, module)
            )
            given = F.transform(renamed, lambda e: pair(e["key"], e["value"]))
            found = F.when(F.size(names) == 0, F.when(F.size(given) > 0, given).otherwise(plain))
        else:
            direct = F.transform(
                F.filter(names, lambda n: n != "*"), lambda n: pair(n, dotted(n))
            )
            given = F.transform(renamed, lambda e: pair(e["key"], dotted(e["value"])))
            found = F.when(F.size(names) > 0, F.concat(direct, given))
        empty = F.array().cast("array<struct<name: string, target: string>>")
        return F.when(module != "", F.coalesce(found, empty)).otherwise(empty)

    return F.flatten(F.transform(imports, of_one))


def index_imports(files: DataFrame) -> DataFrame:
    """Per file: ``members`` (from-imports) and ``aliases`` (module imports) as name -> target.

    A later import of a name replaces an earlier one.
    """
    key = ["repo_key", "path"]
    imports = F.col("imports")
    flagged = lambda aliases: F.transform(
        _entries(imports, aliases),
        lambda e: F.struct(F.lit(aliases).alias("is_alias"), e["name"].alias("name"), e["target"].alias("target")),
    )
    entries = files.select(*key, F.posexplode(F.concat(flagged(False), flagged(True))).alias("pos", "e"))
    last = entries.groupBy(*key, "e.is_alias", "e.name").agg(
        F.max_by("e.target", "pos").alias("target")
    )
    named = lambda want: F.map_from_entries(
        F.collect_list(F.when(F.col("is_alias") == want, F.struct("name", "target")))
    )
    per_file = last.groupBy(*key).agg(named(False).alias("members"), named(True).alias("aliases"))
    empty = F.create_map().cast("map<string,string>")
    return files.select(*key, "module_name").join(per_file, key, "left").select(
        *key, "module_name",
        F.coalesce("members", empty).alias("members"), F.coalesce("aliases", empty).alias("aliases"),
    )


def _candidates(text: Column) -> Column:
    """Qualified names a call text may mean in its function, as (priority, strategy, candidate)."""
    dotted = F.contains(text, F.lit("."))
    head = F.substring_index(text, ".", 1)
    tail = text.substr(F.length(head) + 1, F.length(text))
    own = F.regexp_extract(text, r"(?s)^(?:self|cls)\.(.*)$", 1)
    member_head = F.try_element_at(F.col("members"), head)
    alias_head = F.try_element_at(F.col("aliases"), head)
    parent, module = F.col("parent_class"), F.col("module_name")
    options = (
        (EXACT, text),
        (SELF_METHOD, F.when(own != "", F.concat(parent, F.lit("."), own))),
        (IMPORT_ALIAS, F.when(dotted, F.concat(alias_head, tail))),
        (IMPORT_MEMBER, F.when(dotted, F.concat(member_head, tail))),
        (SAME_MODULE, F.when(~dotted & (module != ""), F.concat(module, F.lit("."), text))),
        (IMPORT_MEMBER, F.when(~dotted, F.try_element_at(F.col("members"), text))),
    )
    structs = [
        F.struct(
            F.lit(i).alias("priority"), F.lit(name).alias("strategy"), option.alias("candidate")
        )
        for i, (name, option) in enumerate(options)
    ]
    return F.filter(F.array(*structs), lambda c: c["candidate"].isNotNull())


def call_sites(functions: DataFrame, files: DataFrame) -> DataFrame:
    """One row per call site with a non-blank callee and the names it may mean (``options``).

    Functions meet their file before the calls are unfolded, and the options are worked out on the
    nested calls, so import maps are neither shuffled nor copied per call.
    """
    callers = functions.where(F.col("n_calls") > 0).select(
        "repo_key", F.col("file_path").alias("path"), F.col("qualified_name").alias("caller"),
        "parent_class", "calls",
    )
    site = lambda call: F.struct(
        F.trim(call["callee"]).alias("callee_text"),
        F.coalesce(call["line"], F.lit(0)).alias("line"),
        _candidates(F.trim(call["callee"])).alias("options"),
    )
    return (
        callers.join(index_imports(files), ["repo_key", "path"])
        .select("repo_key", "caller", "path", F.posexplode(F.transform("calls", site)).alias("site", "c"))
        .select("repo_key", "caller", "path", "site", "c.*")
        .where(F.length("callee_text") > 0)
    )


def resolve_calls(functions: DataFrame, files: DataFrame) -> DataFrame:
    """Every call site with the function it resolves to and the strategy, or unresolved.

    All candidates of a site meet the function index in one join instead of one per strategy; the
    best match is then picked by a partial aggregate.
    """
    index = functions.select("repo_key", F.col("qualified_name").alias("candidate")).distinct()
    key = ["repo_key", "caller", "path", "site"]
    options = call_sites(functions, files).select(
        *key, "line", "callee_text", F.explode("options").alias("option")
    ).select(*key, "line", "callee_text", "option.*")
    # names called from everywhere make hot keys; a measuring pass would evaluate the candidates
    # twice, so this join is left to adaptive skew handling (session.SETTINGS), which splits them
    matched = options.join(index.withColumn("found", F.lit(True)), ["repo_key", "candidate"], "left")
    # misses go, but for the first candidate, which stands for the site itself
    matched = matched.where(F.col("found") | (F.col("priority") == 0))
    hit = F.when(F.col("found"), F.struct("priority", "strategy", "candidate"))
    return (
        matched.groupBy(*key, "line", "callee_text")
        .agg(F.min(hit).alias("best"))
        .select(
            *key, "line", "callee_text",
            F.col("best.candidate").alias("callee"),
            F.coalesce("best.strategy", F.lit(UNRESOLVED)).alias("strategy"),
        )
    )


def call_edges(resolved: DataFrame) -> DataFrame:
    """Edges keyed by (repo, caller, callee, line); the last call site of a key gives its text."""
    return (
        resolved.where(F.col("callee").isNotNull())
        .groupBy("repo_key", "caller", "callee", "line")
        .agg(
            F.max_by(F.struct("strategy", "callee_text"), F.struct("path", "site")).alias("last"),
            F.max("path").alias("file_path"),
        )
        .select(
            "repo_key", "caller", "callee", "line", "file_path",
            F.col("last.strategy").alias("derivation"), F.col("last.callee_text").alias("callee_text"),
        )
    )


def write_call_edges(edges: DataFrame, path: str, repos: DataFrame | None = None) -> None:
    """Replace the stored call edges of ``repos`` (repo_key); those of other repositories stay.

    A repository listed without edges loses its old ones; without the list only the repositories
    present in ``edges`` are replaced.
    """
    resolved = edges if repos is None else repos
    replace_scopes(edges, path, resolved.select("repo_key"), ["repo_key"])


def call_resolution_stats(resolved: DataFrame) -> DataFrame:
    """Per repository: callers, sites, resolved, unresolved and the resolution rate."""
    # a caller's sites are first folded to one row, so no task holds the whole caller set
    per_caller = resolved.groupBy("repo_key", "caller", "path").agg(
        F.count(F.lit(1)).alias("sites"), F.count("callee").alias("resolved")
    )
    total = per_caller.groupBy("repo_key").agg(
        F.count(F.lit(1)).alias("callers"),
        F.sum("sites").alias("sites"),
        F.sum("resolved").alias("resolved"),
    )
    return total.withColumn("unresolved", F.col("sites") - F.col("resolved")).withColumn(
        "rate", F.when(F.col("sites") > 0, F.col("resolved") / F.col("sites")).otherwise(0.0)
    )


def calls_by_strategy(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("repo_key", "strategy").agg(F.count(F.lit(1)).alias("sites"))


def _call_ends(
    calls: DataFrame, functions: DataFrame, near: str, far: str, limit: int | None, qname: str | None
) -> DataFrame:
    """For each function at the ``near`` end its edges; with ``limit`` the first by name of the far
    end, ranked.
    """
    edges = calls if qname is None else calls.where(F.col(near) == qname)
    first = edges.select("repo_key", near, far, "line", "derivation")
    if limit is not None:
        first = first_per_key(
            first, ["repo_key", near], [F.asc(far), F.asc("line")], limit, rank="rank"
        )
    facts = functions.select(
        "repo_key", F.col("qualified_name").alias(far), "file_path", "signature"
    )
    return first.join(facts, ["repo_key", far], "left")


def get_callers(
    calls: DataFrame, functions: DataFrame, qname: str | None = None, limit: int | None = None
) -> DataFrame:
    """Callers of one function, or of each, by name."""
    return _call_ends(calls, functions, "callee", "caller", limit, qname)


def get_dependencies(
    calls: DataFrame, functions: DataFrame, qname: str | None = None, limit: int | None = None
) -> DataFrame:
    """Functions that one function, or each, calls, by name."""
    return _call_ends(calls, functions, "caller", "callee", limit, qname)


def contains_edges(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """File -> function, file -> class and class -> method edges with the kind of the parent."""
    edge = lambda parent, kind, child: (
        F.col("repo_key"), F.col(parent).alias("parent"), F.lit(kind).alias("parent_kind"),
        F.col(child).alias("child"),
    )
    in_file = functions.select(*edge("file_path", "file", "qualified_name"))
    classes_in_file = classes.select(*edge("file_path", "file", "qualified_name"))
    methods = functions.where(F.col("parent_class").isNotNull()).select(
        *edge("parent_class", "class", "qualified_name")
    )
    known = files.select("repo_key", F.col("path").alias("parent"))
    from_files = in_file.unionByName(classes_in_file).join(
        known, ["repo_key", "parent"], "left_semi"
    )
    return from_files.unionByName(methods)


# containers of one name, or of the hits of one query, that are compared as a list
FEW = 16


def _listed(df: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """``df`` with the ``value`` of the rows of equal ``keys`` (null keys equal) as the list ``out``; of more than
    ``FEW`` only the first by parent, and one."""
    lists = first_per_key(df.select(*keys, "parent", value.alias("_value")), keys, [F.asc("parent")], FEW + 1).groupBy(
        *[F.col(k).alias(f"_{k}") for k in keys]
    ).agg(F.collect_list("_value").alias(out))
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return df.join(lists, same).drop(*[f"_{k}" for k in keys])


def graph_expand(hits: DataFrame, contains: DataFrame, cap: int | None = None) -> DataFrame:
    """Containers of each hit and the other members of those containers.

    ``hits`` has query_id, repo_key, qualified_name; ``contains`` has repo_key, parent,
    parent_kind, child. With ``cap`` the first so many distinct names per query come back. Only the
    first ``cap + 1`` members of a container can ever be among them (one may be the hit itself), so
    each container is cut to that many before it meets the hits. Containers of very many hits are
    spread over tasks. Pairs of a query and a member are not shuffled to merge those that several containers
    give, unless the name or the query has more than ``FEW`` containers.
    """
    parents = hits.join(
        contains.select("repo_key", F.col("child").alias("qualified_name"), "parent", "parent_kind"),
        ["repo_key", "qualified_name"],
    )
    members = contains.select("repo_key", "parent", "child").where("child is not null").distinct()
    if cap is not None:
        members = first_per_key(members, ["repo_key", "parent"], [F.asc("child")], cap + 1)
    # a query meets a container once: two hits in it make every member a sibling of one of them
    met = parents.groupBy("query_id", "repo_key", "parent").agg(
        F.min("qualified_name").alias("_first"), F.max("qualified_name").alias("_last"),
        F.max("parent_kind").alias("container_kind"),
    )
    met = met.withColumn("_sole", F.when(F.col("_first") == F.col("_last"), F.col("_first"))).drop("_first", "_last")
    listed = _listed(met, ["query_id", "repo_key"], F.struct("parent", "_sole"), "_met")
    met = materialize(listed.withColumn("_names", F.col("_met.parent")), "containers-met")
    members = materialize(_listed(members, ["repo_key", "child"], F.col("parent"), "_of"), "container-members")
    few, many = "size({0}) <= {1}".format, "size({0}) > {1}".format
    siblings = lambda of, held: (
        pair_join(of, held, ["repo_key", "parent"], ["query_id"]).where(~F.col("child").eqNullSafe(F.col("_sole")))
        .withColumnRenamed("child", "qualified_name")
    )
    out = ["query_id", "repo_key", "qualified_name", "container_kind"]
    no_kind = F.lit(None).cast("string").alias("container_kind")
    containers = met.withColumnRenamed("parent", "qualified_name").select(*out, "_met")
    # a name comes from the first container that gives it, and not where it is a container itself
    slim = met.where(few("_met", FEW))
    new = ~F.coalesce(F.array_contains("_names", F.col("qualified_name")), F.lit(False))
    first = F.expr("array_min(transform(filter(_met, m -> array_contains(_of, m.parent) AND NOT m._sole <=> qualified_name), m -> m.parent))")
    mine = F.when((F.size("_met") == 1) | (F.size("_of") == 1), True).otherwise(F.col("parent") == first)
    once = siblings(slim, members.where(few("_of", FEW))).where(new & mine).select(*out[:3], no_kind)
    # of what lies in many containers the pairs are merged
    again = siblings(slim, members.where(many("_of", FEW))).where(new).select(*out[:3], no_kind).distinct()
    wide = siblings(met.where(many("_met", FEW)), members).select(*out[:3], no_kind).unionByName(
        containers.where(many("_met", FEW)).select(*out)
    ).groupBy(*out[:3]).agg(F.max("container_kind").alias("container_kind"))
    found = containers.where(few("_met", FEW)).select(*out).unionByName(once).unionByName(again).unionByName(wide)
    if cap is None:
        return found
    return first_per_key(
        found, ["query_id"], [F.asc("qualified_name"), F.asc("repo_key")], cap
    )


def neighbors(nodes: DataFrame, contains: DataFrame, qname: str | None = None) -> DataFrame:
    """Parents and children of each node as one edge list (role, other)."""
    wanted = nodes if qname is None else nodes.where(F.col("qualified_name") == qname)
    wanted = wanted.select("repo_key", "qualified_name").distinct()
    up = contains.select(
        "repo_key", F.col("child").alias("qualified_name"), F.lit("parent").alias("role"),
        F.col("parent").alias("other"),
    )
    down = contains.select(
        "repo_key", F.col("parent").alias("qualified_name"), F.lit("child").alias("role"),
        F.col("child").alias("other"),
    )
    edges = up.unionByName(down).distinct()
    return wanted.join(edges, ["repo_key", "qualified_name"], "left")


def who_owns(requests: DataFrame, repos: DataFrame, files: DataFrame) -> DataFrame:
    """File facts per requested path; ``found`` is false for an unknown path.

    Author and last commit are not part of the data model and stay null.
    """
    known = files.join(
        repos.select(F.col("key").alias("repo_key"), "spec"), "repo_key"
    ).select("repo_key", "spec", "path", "language", "loc", "module_name")
    one = first_per_key(known, ["path"], [F.asc("repo_key")], 1)
    return requests.select("path").distinct().join(one, "path", "left").select(
        "*",
        F.col("repo_key").isNotNull().alias("found"),
        F.lit(None).cast("string").alias("author"),
        F.lit(None).cast("string").alias("last_commit"),
    )


def chunk_texts(parsed_files: DataFrame, body_chars: int = 800) -> DataFrame:
    """Text to embed per function and class, built from the per-file row that holds the source.

    Slicing happens before the source is dropped, so file texts are never shuffled or repeated.
    """
    lines = F.split("source", "\r\n|\n|\r")

    def body(node: Column) -> Column:
        part = F.slice(lines, node["start_line"], node["end_line"] - node["start_line"] + 1)
        return F.substring(F.array_join(part, "\n"), 1, body_chars)

    def tagged(prefix: str, names: Column) -> Column:
        return F.when(F.size(names) > 0, F.concat(F.lit(prefix), F.array_join(names, ", ")))

    def text(parts: list[Column], node: Column) -> Column:
        quoted = F.when(body(node) != "", F.concat(F.lit("\n"), body(node)))
        return F.concat_ws("\n", *parts, quoted)

    def note(value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit("# "), value))

    nodes = parsed_files.select("repo_key", "path", "source", "functions", "classes")
    fn, cls = F.col("fn"), F.col("cls")
    functions = nodes.select("*", F.explode("functions").alias("fn")).select(
        "repo_key", "path", fn["qualified_name"].alias("qualified_name"),
        F.lit("function").alias("kind"),
        text(
            [
                F.concat(F.lit("# "), fn["qualified_name"], fn["signature"]),
                note(fn["docstring"]),
                tagged("# decorators: ", fn["decorators"]),
            ],
            fn,
        ).alias("text"),
    )
    classes = nodes.select("*", F.explode("classes").alias("cls")).select(
        "repo_key", "path", cls["qualified_name"].alias("qualified_name"),
        F.lit("class").alias("kind"),
        text(
            [
                F.concat(F.lit("# class "), cls["qualified_name"]),
                tagged("# inherits: ", cls["base_classes"]),
                note(cls["docstring"]),
                tagged("# decorators: ", cls["decorators"]),
                tagged(
                    "# methods: ",
                    F.transform(cls["method_qnames"], lambda m: F.substring_index(m, ".", -1)),
                ),
            ],
            cls,
        ).alias("text"),
    )
    return functions.unionByName(classes)


def ingest_stats(files: DataFrame, functions: DataFrame, classes: DataFrame) -> DataFrame:
    """Per repository and language: files, lines, imports, files with errors, functions, calls, classes."""
    per_file = files.groupBy("repo_key", "language").agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("loc").alias("loc"),
        F.sum(F.size("imports")).alias("imports"),
        F.count_if(F.size("parse_errors") > 0).alias("error_files"),
    )
    language = files.select("repo_key", F.col("path").alias("file_path"), "language")
    per_function = functions.join(language, ["repo_key", "file_path"]).groupBy(
        "repo_key", "language"
    ).agg(F.count(F.lit(1)).alias("functions"), F.sum("n_calls").alias("calls"))
    per_class = classes.join(language, ["repo_key", "file_path"]).groupBy(
        "repo_key", "language"
    ).agg(F.count(F.lit(1)).alias("classes"))
    keys = ["repo_key", "language"]
    return per_file.join(per_function, keys, "left").join(per_class, keys, "left").na.fill(0)
