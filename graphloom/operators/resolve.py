"""What names in sources mean: entities and typed edges from the rows of `sources.java`, by joins.

A name is looked up in the scope of a type, nearest first: enclosing and nested types, explicit imports (one that leads
outside the project ends the search), the file's package, wildcard imports. Members are found in a type or else in its
nearest supertype; arity decides, so overloads with equal arity all match. Receivers of calls are resolved step by step
from the left, MAX_STEPS at most. Nesting and supertypes are followed until nothing is added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions import text as fn
from graphloom.tables import written

# fixed value: steps of a chained call that are followed
MAX_STEPS = 8
# fixed values: what annotations say of a type's role, and of HTTP methods
ROLES = {
    "RestController": "CONTROLLER", "Controller": "CONTROLLER", "Path": "CONTROLLER", "Service": "SERVICE", "Repository": "REPOSITORY", "Configuration": "CONFIGURATION", "SpringBootApplication": "CONFIGURATION",
    "AutoConfiguration": "CONFIGURATION", "Entity": "ENTITY", "Table": "ENTITY", "Document": "ENTITY", "Embeddable": "ENTITY", "MappedSuperclass": "ENTITY", "Component": "COMPONENT",
}
REPOSITORY_BASES = ("Repository", "CrudRepository", "ListCrudRepository", "PagingAndSortingRepository", "JpaRepository", "MongoRepository", "ReactiveCrudRepository")
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}
JAXRS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")
TEST_MARKS = ("Test", "ParameterizedTest", "RepeatedTest", "TestFactory")


def simple(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def mark(annotation: Column) -> Column:
    """Simple name of an annotation's text."""
    return simple(F.regexp_extract(annotation, r"^([\w.]+)", 1))


class Names:
    """Look-up tables of one project: types, their scopes, supertypes, methods and fields."""

    def __init__(self, spark: SparkSession, facts: DataFrame):
        self.spark = spark
        w = Window.partitionBy("owner").orderBy("path", "place")
        types = facts.where("what = 'type'").withColumn("n_", F.row_number().over(w)).where("n_ = 1")  # the first file wins
        package = facts.where("what = 'package'").groupBy("path").agg(F.min("name").alias("package"))
        self.types = written(spark, types.join(package, "path", "left").select("path", "owner", "name", "kind", F.col("scope").alias("outer"), "supers", "annotations", "modifiers", "visibility", "start_line", "end_line", F.coalesce("package", F.lit("")).alias("package")))
        self.facts = written(spark, facts.join(self.types.select("path", "owner"), ["path", "owner"], "left_semi").unionByName(facts.where("owner is null")))
        known = self.types.select(F.col("owner").alias("target"))
        self.known = known
        # scopes: candidates by simple name for each type, nearest first
        chain = self.types.select("path", "owner", F.col("owner").alias("at"), F.lit(0).alias("far"))
        up = self.types.select(F.col("owner").alias("at"), F.col("outer").alias("next"))
        every, far = chain, 0
        while True:
            far += 1
            chain = written(spark, chain.join(up, "at").where("next is not null").select("path", "owner", F.col("next").alias("at"), F.lit(far).alias("far")))
            if chain.isEmpty():
                break
            every = every.unionByName(chain)
        every = written(spark, every)
        self.enclosing = every
        nested = self.types.where("outer is not null").select(F.col("outer").alias("at"), F.col("name").alias("head"), F.col("owner").alias("target"))
        itself = self.types.select(F.col("owner").alias("at"), F.col("name").alias("head"), F.col("owner").alias("target"))
        inside = every.join(nested.unionByName(itself), "at").select("owner", "head", "target", (F.col("far") + 1).alias("rank"))
        imports = self.facts.where("what = 'import'").select("path", "name", "kind")
        plain = imports.where("kind is null and not endswith(name, '*')").select("path", simple(F.col("name")).alias("head"), F.col("name").alias("target"))
        here = self.types.select("path", "owner", "package")
        explicit = plain.join(here, "path").select("owner", "head", "target", F.lit(100).alias("rank"))
        of_package = self.types.where("outer is null").select("package", F.col("name").alias("head"), F.col("owner").alias("target"))
        same = here.join(of_package, "package").select("owner", "head", "target", F.lit(200).alias("rank"))
        wild = imports.where("kind is null and endswith(name, '*')").select("path", F.regexp_replace("name", r"\.\*$", "").alias("package"))
        wide = wild.join(of_package, "package").join(here.select("path", "owner"), "path").select("owner", "head", "target", F.lit(300).alias("rank"))
        best = inside.unionByName(explicit).unionByName(same).unionByName(wide).groupBy("owner", "head").agg(F.min(F.struct("rank", "target")).alias("best"))
        self.scope = written(spark, best.select("owner", "head", F.col("best.target").alias("base")))
        self.supers = self._supers()
        self.lineage = self._lineage()
        m = self.facts.where("what = 'method'").select("owner", "member", "name", "type_text", "kind", "args", "params", "modifiers", "visibility", "scope")
        self.methods = written(spark, m.withColumn("varargs", F.coalesce(F.col("scope") == "varargs", F.lit(False))).drop("scope").dropDuplicates(["member"]))
        self.fields = written(spark, self.facts.where("what = 'field'").select("owner", "member", "name", "type_text").dropDuplicates(["member"]))

    def resolve(self, rows: DataFrame, token: str = "token", owner: str = "owner", target: str = "target") -> DataFrame:
        """rows with target: the type of the project that a name, perhaps dotted, means inside a type; null for others."""
        asked = rows.select(F.col(owner).alias("o_"), F.col(token).alias("t_")).where("t_ is not null and o_ is not null").distinct()
        heads = asked.withColumn("head", F.substring_index("t_", ".", 1)).join(self.scope.select(F.col("owner").alias("o_"), "head", "base"), ["o_", "head"], "left")
        rest = F.expr("substring(t_, length(head) + 1)")
        heads = heads.withColumn("guess", F.when(F.col("base").isNotNull(), F.concat("base", rest)).otherwise(F.col("t_")))
        found = heads.join(self.known.select(F.col("target").alias("guess"), F.lit(True).alias("real")), "guess", "left")
        found = found.where("real").select("o_", "t_", F.col("guess").alias(target))
        return rows.join(found, (F.col(owner) == F.col("o_")) & (F.col(token) == F.col("t_")), "left").drop("o_", "t_")

    def _supers(self) -> DataFrame:
        """owner, how, token, target, place of every supertype that a type names."""
        each = self.types.select("owner", F.posexplode("supers").alias("place", "text")).select("owner", "place", F.substring_index("text", ":", 1).alias("how"), F.expr("substring(text, instr(text, ':') + 1)").alias("text"))
        each = each.withColumn("token", F.try_element_at(fn.type_tokens("text"), F.lit(1)))
        return written(self.spark, self.resolve(each))

    def _lineage(self) -> DataFrame:
        """owner, super, distance: a type itself and all its supertypes, by the shortest way."""
        direct = self.supers.where("target is not null").select(F.col("owner").alias("super"), F.col("target").alias("next")).distinct()
        all_ = step = self.types.select("owner", F.col("owner").alias("super"), F.lit(0).alias("distance"))
        far = 0
        while True:
            far += 1
            step = step.join(direct, "super").select("owner", F.col("next").alias("super"), F.lit(far).alias("distance")).distinct()
            step = written(self.spark, step.join(all_.select("owner", "super"), ["owner", "super"], "left_anti"))  # loops of supertypes end
            if step.isEmpty():
                return written(self.spark, all_)
            all_ = all_.unionByName(step)

    def find_methods(self, asked: DataFrame, keys: list[str], on: str = "at") -> DataFrame:
        """asked (keys, on: a type, name, args) with found, declared, returns: the methods of that name that fit, of the
        type or of its nearest supertype with any; arity -1 fits all, variable arity all from one less on."""
        m = self.methods.select(F.col("owner").alias("declared"), F.col("member").alias("found"), F.col("name").alias("name_"), F.col("args").alias("n_"), "varargs", F.col("type_text").alias("returns"), "kind")
        line = self.lineage.select(F.col("owner").alias("on_"), F.col("super").alias("declared"), "distance")
        rows = asked.join(line, F.col(on) == F.col("on_")).join(m, "declared").where("name = name_")
        rows = rows.where("(args = n_ or args = -1 or (varargs and args >= n_ - 1)) and (kind <> 'CONSTRUCTOR' or distance = 0)")
        rows = rows.withColumn("r_", F.rank().over(Window.partitionBy(*keys).orderBy("distance")))
        return rows.where("r_ = 1").drop("on_", "distance", "name_", "n_", "varargs", "kind", "r_")

    def find_field(self, asked: DataFrame, keys: list[str], name: str, on: str = "at") -> DataFrame:
        """asked with declared, type_text of the field of that name, own or of the nearest supertype."""
        f = self.fields.select(F.col("owner").alias("declared"), F.col("name").alias("field_"), "type_text")
        line = self.lineage.select(F.col("owner").alias("on_"), F.col("super").alias("declared"), "distance")
        rows = asked.join(line, F.col(on) == F.col("on_")).join(f, "declared").where(F.col(name) == F.col("field_"))
        rows = rows.withColumn("r_", F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "declared")))
        return rows.where("r_ = 1").drop("on_", "distance", "field_", "r_")

    def typed(self, rows: DataFrame, text: str, owner: str, target: str) -> DataFrame:
        """rows with the type that a type's text means inside another."""
        rows = rows.withColumn("token_", F.try_element_at(fn.type_tokens(text), F.lit(1)))
        return self.resolve(rows, "token_", owner, target).drop("token_")


def receivers(names: Names, calls: DataFrame) -> DataFrame:
    """Distinct (member, owner, scope) of calls with a scope, and at: the type that it has, where it is one of the project's."""
    spark = names.spark
    keys = ["member", "owner", "scope"]
    asked = calls.where("scope is not null and scope <> '?'").select(*keys).distinct()
    # from the left: a base, then names of fields and calls (name/args)
    parts = F.regexp_extract_all("scope", F.lit(r"call \S+|new \S+|\S+"), F.lit(0))
    asked = asked.withColumn("parts", F.reverse(parts))
    first = F.element_at("parts", 1)
    called = F.startswith(first, F.lit("call "))
    fields = F.when(called | F.startswith(first, F.lit("new ")), F.array().cast("array<string>")).otherwise(F.slice(F.split(first, r"\."), 2, 100))
    asked = asked.withColumn("base", F.when(called, F.lit("this")).when(F.startswith(first, F.lit("new ")), first).otherwise(F.substring_index(first, ".", 1)))
    asked = asked.withColumn("steps", F.concat(fields, F.when(called, F.col("parts")).otherwise(F.slice("parts", 2, 100)))).withColumn("dotted", F.when(called, F.lit("")).otherwise(first))
    asked = written(spark, asked.drop("parts"))
    # bases: a parameter, a local, a field (own, then of the types around), a type
    shapes = names.facts.where("what in ('param', 'local')").select("member", F.col("name").alias("base"), "type_text", F.when(F.col("what") == "param", 0).otherwise(1).alias("rank"), "place")
    near = names.typed(asked.join(shapes, ["member", "base"]).select(*keys, "type_text", "rank", "place"), "type_text", "owner", "at").select(*keys, "at", "rank", "place")
    around = asked.join(names.enclosing.select("owner", F.col("at").alias("in_"), "far"), "owner").select(*keys, "base", "in_", "far")
    own = names.find_field(around, [*keys, "in_"], "base", "in_").select(*keys, "declared", "type_text", "far")
    own = names.typed(own, "type_text", "declared", "at").select(*keys, "at", (F.col("far") + 10).alias("rank"), F.lit(0).alias("place"))
    types = names.resolve(asked, "base").select(*keys, F.col("target").alias("at"), F.lit(100).alias("rank"), F.lit(0).alias("place")).where("at is not null")
    made = names.typed(asked.where("startswith(base, 'new ')").withColumn("text", F.expr("substring(base, 5)")), "text", "owner", "at").select(*keys, "at", F.lit(0).alias("rank"), F.lit(0).alias("place"))
    parent = names.supers.where("how = 'EXTENDS' and target is not null").groupBy("owner").agg(F.min_by("target", "place").alias("at"))
    me = asked.where("base = 'this'").select(*keys, F.col("owner").alias("at"), F.lit(0).alias("rank"), F.lit(0).alias("place"))
    above = asked.where("base = 'super'").select(*keys).join(parent, "owner").select(*keys, "at", F.lit(0).alias("rank"), F.lit(0).alias("place"))
    every = near.unionByName(own).unionByName(types).unionByName(made).unionByName(me).unionByName(above)
    base = every.groupBy(*keys).agg(F.min(F.struct("rank", "place", "at")).alias("b")).select(*keys, F.col("b.at").alias("at"))
    # whole dotted names of types
    static = names.resolve(asked.where("contains(dotted, '.') and not startswith(dotted, 'this.') and not startswith(dotted, 'super.')"), "dotted").where("target is not null").select(*keys, F.col("target").alias("static"), F.size(F.split("dotted", r"\.")).alias("used"))
    now = asked.join(base, keys, "left").join(static, keys, "left")
    now = now.withColumn("steps", F.when(F.col("static").isNotNull(), F.slice("steps", F.col("used"), F.lit(100))).otherwise(F.col("steps"))).withColumn("at", F.coalesce("static", "at"))
    now = written(spark, now.select(*keys, "steps", "at").where("at is not null"))
    done = now.where("size(steps) = 0").select(*keys, "at")
    for _ in range(MAX_STEPS):
        now = now.where("size(steps) > 0").withColumn("step", F.element_at("steps", 1)).withColumn("steps", F.slice("steps", 2, 100))
        call = now.where("startswith(step, 'call ')").withColumn("name", F.regexp_extract("step", r"^call (.*)/", 1)).withColumn("args", F.regexp_extract("step", r"/(-?\d+)$", 1).cast("int"))
        call = names.find_methods(call, keys).groupBy(*keys, "steps").agg(F.min(F.struct("found", "declared", "returns")).alias("f")).select(*keys, "steps", "f.declared", F.col("f.returns").alias("type_text"))
        field = names.find_field(now.where("not startswith(step, 'call ')"), keys, "step").select(*keys, "steps", "declared", "type_text")
        now = written(spark, names.typed(call.unionByName(field), "type_text", "declared", "at").where("at is not null").select(*keys, "steps", "at"))
        done = done.unionByName(now.where("size(steps) = 0").select(*keys, "at"))
        if now.where("size(steps) > 0").isEmpty():
            break
    return written(spark, done)


def calls(names: Names, facts: DataFrame) -> DataFrame:
    """src (a member), dst (a method) of every call among these facts that resolves."""
    rows = facts.where("what = 'call' and member is not null").select("member", "owner", "name", "scope", "args")
    keys = ["member", "name", "args"]
    bare = rows.where("scope is null").select("owner", *keys).distinct()
    around = bare.join(names.enclosing.select("owner", F.col("at"), "far"), "owner")
    own = names.find_methods(around, [*keys, "at"])
    own = own.withColumn("r2", F.rank().over(Window.partitionBy(*keys).orderBy("far"))).where("r2 = 1").select(*keys, "found")
    static = names.facts.where("what = 'import' and kind = 'static'").select("path", F.regexp_replace("name", r"\.[^.]*$", "").alias("at"), simple(F.col("name")).alias("what_"))
    static = static.join(names.types.select("path", "owner"), "path").select("owner", "at", "what_")
    more = bare.join(own.select(*keys).distinct(), keys, "left_anti").join(static, "owner").where("what_ = name or what_ = '*'")
    more = names.find_methods(more, [*keys, "at"]).select(*keys, "found")
    through = rows.join(receivers(names, rows), ["member", "owner", "scope"]).select(*keys, "scope", "at").distinct()
    through = names.find_methods(through, [*keys, "scope"]).select(*keys, "found")
    every = own.unionByName(more).unionByName(through)
    return every.select(F.col("member").alias("src"), F.col("found").alias("dst"))


def overrides(names: Names, types: DataFrame) -> DataFrame:
    """src, dst: a method and those of supertypes with its name and parameters; type parameters of theirs stand for any type."""
    m = names.methods.where("kind = 'METHOD'").withColumn("static", F.contains(F.coalesce("modifiers", F.lit("")), F.lit("static"))).where("not static")
    own = m.where("visibility <> 'private'").join(types.select("owner"), "owner", "left_semi").select("owner", F.col("member").alias("src"), "name", "args", "params")
    up = m.where("visibility <> 'private'").select(F.col("owner").alias("super"), F.col("member").alias("dst"), "name", "args", F.col("params").alias("theirs"))
    rows = own.join(names.lineage.where("distance > 0"), "owner").join(up, ["super", "name", "args"])
    free = names.facts.where("what = 'typeparam'")
    of_type = free.where("member is null").groupBy(F.col("owner").alias("super")).agg(F.collect_set("name").alias("of_type"))
    of_method = free.where("member is not null").groupBy(F.col("member").alias("dst")).agg(F.collect_set("name").alias("of_method"))
    rows = rows.join(of_type, "super", "left").join(of_method, "dst", "left")
    open_ = F.concat(*(F.coalesce(c, F.array().cast("array<string>")) for c in ("of_type", "of_method")))
    return rows.where(F.forall(F.zip_with("params", "theirs", lambda a, b: (a == b) | F.array_contains(open_, b)), lambda x: x)).select("src", "dst")


def edges(names: Names, only: DataFrame | None = None) -> DataFrame:
    """src, dst (qualified names), type, weight: everything that the declarations of all files, or of those in only (path),
    depend on; no self-edges."""
    spark, parts = names.spark, []
    facts, types = (x if only is None else written(spark, x.join(only.select("path"), "path", "left_semi")) for x in (names.facts, names.types))
    supers = names.supers.join(types.select("owner"), "owner", "left_semi")

    def add(rows: DataFrame, kind: str | None = None) -> None:
        parts.append(rows.select("src", "dst", (F.lit(kind) if kind else F.col("type")).alias("type")))

    add(supers.where("target is not null").select(F.col("owner").alias("src"), F.col("target").alias("dst"), F.col("how").alias("type")))
    arguments = types.select("owner", F.explode("supers").alias("text")).select("owner", F.explode(F.slice(fn.type_tokens(F.expr("substring(text, instr(text, ':') + 1)")), 2, 100)).alias("token"))
    used = facts.where("type_text is not null and what in ('field', 'method', 'param', 'local', 'use')").select("owner", F.coalesce("member", "owner").alias("src"), F.explode(fn.type_tokens("type_text")).alias("token"))
    made = facts.where("what = 'new' and member is not null").select("owner", F.col("member").alias("src"), "args", fn.type_tokens("type_text").alias("tokens"))
    inner = made.select("owner", "src", F.explode(F.slice("tokens", 2, 100)).alias("token"))
    uses = arguments.select("owner", F.col("owner").alias("src"), "token").unionByName(used).unionByName(inner)
    add(names.resolve(uses).where("target is not null").withColumn("dst", F.col("target")), "USES_TYPE")
    made = written(spark, names.resolve(made.withColumn("token", F.try_element_at("tokens", F.lit(1)))).where("target is not null"))
    add(made.withColumn("dst", F.col("target")), "CREATES")
    built = made.select("src", F.col("target").alias("at"), F.lit("<init>").alias("name"), "args")
    add(names.find_methods(built.distinct(), ["src", "at", "args"]).withColumn("dst", F.col("found")), "CALLS")
    top = types.where("outer is null").select("path", F.col("owner").alias("src"))
    imports = facts.where("what = 'import' and not endswith(name, '*')").select("path", F.when(F.col("kind") == "static", F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name")).alias("dst"))
    add(imports.join(names.known.select(F.col("target").alias("dst")), "dst", "left_semi").join(top, "path"), "IMPORTS")
    marks = facts.where("annotations is not null").select("owner", F.coalesce("member", "owner").alias("src"), F.explode("annotations").alias("a")).withColumn("token", F.regexp_extract("a", r"^([\w.]+)", 1))
    annotation = names.types.where("kind = 'ANNOTATION'").select(F.col("owner").alias("target"))
    add(names.resolve(marks).join(annotation, "target", "left_semi").withColumn("dst", F.col("target")), "ANNOTATED_BY")
    add(calls(names, facts), "CALLS")
    add(overrides(names, types), "OVERRIDES")
    add(endpoints(names).join(types.select("owner"), "owner", "left_semi").select(F.col("qualified_name").alias("src"), F.col("member").alias("dst")), "ROUTES_TO")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("src <> dst").groupBy("src", "dst", "type").agg(F.count("*").alias("weight"))


def _path_of(annotation: Column) -> Column:
    """The path that an annotation names: its only value, or `value` or `path`."""
    return F.coalesce(F.nullif(F.regexp_extract(annotation, r'^[\w.]+\((?:(?:value|path)=)?\{?"([^"]*)"', 1), F.lit("")), F.regexp_extract(annotation, r'[(,](?:value|path)=\{?"([^"]*)"', 1))


def endpoints(names: Names) -> DataFrame:
    """qualified_name, name, http_method, http_path, member, owner of every mapped method."""
    at = names.types.select("owner", F.explode_outer("annotations").alias("a")).where(mark(F.col("a")).isin("RequestMapping", "Path")).groupBy("owner").agg(F.max(_path_of(F.col("a"))).alias("base"))
    rows = names.facts.where("what = 'method'").select("owner", "member", F.explode("annotations").alias("a")).withColumn("m", mark(F.col("a")))
    verb = F.when(F.col("m").isin(*JAXRS), F.col("m")).when(F.col("m") == "RequestMapping", F.coalesce(F.nullif(F.regexp_extract("a", r"method=\{?(?:\w+\.)*(\w+)", 1), F.lit("")), F.lit("ANY")))
    for name, http in MAPPINGS.items():
        verb = F.when(F.col("m") == name, F.lit(http)).otherwise(verb)
    mapped = F.col("m").isin("RequestMapping", "Path", *MAPPINGS)
    rows = rows.withColumn("verb", verb).withColumn("sub", F.when(mapped, _path_of(F.col("a"))))
    rows = rows.groupBy("owner", "member").agg(F.max("verb").alias("http_method"), F.max("sub").alias("sub")).where("http_method is not null").join(at, "owner", "left")
    path = F.regexp_replace(F.concat(F.lit("/"), F.coalesce("base", F.lit("")), F.lit("/"), F.coalesce("sub", F.lit(""))), "/+", "/")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/$", "")).otherwise(path)
    rows = rows.withColumn("http_path", path).withColumn("name", F.concat_ws(" ", "http_method", "http_path"))
    return rows.select(F.concat(F.lit("endpoint:"), "name", F.lit("@"), "member").alias("qualified_name"), "name", "http_method", "http_path", "member", "owner")


def entities(names: Names) -> DataFrame:
    """Types, methods, constructors, fields and endpoints with ids hashed from their qualified names."""
    types, facts = names.types, names.facts
    marks = F.transform(F.coalesce("annotations", F.array().cast("array<string>")), mark)
    table = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    said = F.filter(F.transform(marks, lambda a: table[a]), lambda r: r.isNotNull())
    based = F.exists("supers", lambda s: simple(F.regexp_extract(s, r":([\w.]+)", 1)).isin(*REPOSITORY_BASES))
    tested = facts.where("what = 'method'").select("owner", F.explode("annotations").alias("a")).where(mark(F.col("a")).isin(*TEST_MARKS)).select("owner").distinct().withColumn("tested", F.lit(True))
    role = F.when(fn.is_test("path") | F.coalesce("tested", F.lit(False)), "TEST").when(F.size(said) > 0, F.try_element_at(said, F.lit(1))).when(based, "REPOSITORY")
    members = facts.where("what = 'method'").groupBy("owner").agg(F.sum("complexity").cast("int").alias("total"))
    cols = ["qualified_name", "name", "kind", "parent", "path", "package_name", "stereotype", "http_method", "http_path", "complexity", "is_abstract", "start_line", "end_line", "visibility", "modifiers", "signature", "annotations"]
    nothing = F.lit(None).cast("string")
    listed = F.nullif(F.array_join(F.transform("annotations", lambda a: F.regexp_extract(a, r"^([\w.]+)", 1)), ","), F.lit("")).alias("annotations")
    abstract = F.contains(F.coalesce("modifiers", F.lit("")), F.lit("abstract"))
    t = types.join(tested, "owner", "left").join(members, "owner", "left").select(
        F.col("owner").alias("qualified_name"), "name", "kind", F.col("outer").alias("parent"), "path", F.col("package").alias("package_name"), role.alias("stereotype"), nothing.alias("http_method"), nothing.alias("http_path"),
        F.greatest(F.lit(1), F.coalesce("total", F.lit(0))).alias("complexity"), (abstract | F.col("kind").isin("INTERFACE", "ANNOTATION")).alias("is_abstract"), "start_line", "end_line", "visibility", "modifiers",
        fn.signature("kind", "visibility", F.coalesce("modifiers", F.lit("")), nothing, "name", nothing).alias("signature"), listed,
    )
    package = types.select("owner", F.col("package").alias("package_name"))
    m = facts.where("what in ('method', 'field')").dropDuplicates(["member"]).join(package, "owner").withColumn("kind", F.coalesce("kind", F.lit("FIELD")))
    shown = F.when(F.col("kind") == "CONSTRUCTOR", simple(F.col("owner"))).otherwise(F.col("name"))
    m = m.select(
        F.col("member").alias("qualified_name"), shown.alias("name"), "kind", F.col("owner").alias("parent"), "path", "package_name", nothing.alias("stereotype"), nothing.alias("http_method"), nothing.alias("http_path"),
        F.coalesce("complexity", F.lit(1)).alias("complexity"), abstract.alias("is_abstract"), "start_line", "end_line", "visibility", "modifiers",
        fn.signature("kind", "visibility", F.coalesce("modifiers", F.lit("")), "type_text", shown, F.array_join("params", ", ")).alias("signature"), listed,
    )
    e = endpoints(names).join(types.select("owner", "path", F.col("package").alias("package_name")), "owner").select(
        "qualified_name", "name", F.lit("ENDPOINT").alias("kind"), F.col("owner").alias("parent"), "path", "package_name", nothing.alias("stereotype"), "http_method", "http_path", F.lit(1).alias("complexity"), F.lit(False).alias("is_abstract"),
        F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), nothing.alias("visibility"), nothing.alias("modifiers"), F.col("name").alias("signature"), nothing.alias("annotations"),
    )
    out = t.select(*cols).unionByName(m.select(*cols)).unionByName(e.select(*cols))
    return out.withColumn("id", F.xxhash64("qualified_name")).withColumn("parent_id", F.when(F.col("parent").isNotNull(), F.xxhash64("parent"))).withColumn("file_id", F.xxhash64("path"))


def linked(spark: SparkSession, entity: DataFrame, found: DataFrame) -> DataFrame:
    """Edges by qualified names as edges by ids, with the file of their source; ends that are no entities drop out."""
    by_name = entity.select("qualified_name", "id", "file_id")
    links = found.join(by_name.select(F.col("qualified_name").alias("src"), F.col("id").alias("a"), "file_id"), "src").join(by_name.select(F.col("qualified_name").alias("dst"), F.col("id").alias("b")), "dst")
    return written(spark, links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "type", F.col("weight").cast("long").alias("weight"), "file_id"))


def analyse(spark: SparkSession, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entity and edge tables of a project's files (path, module, text)."""
    from graphloom.sources import java

    names = Names(spark, written(spark, java.facts(files)))
    entity = written(spark, entities(names).join(files.select("path", "module"), "path", "left"))
    return entity, linked(spark, entity, edges(names))
