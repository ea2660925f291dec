"""Code-structure mining: one ``ast`` pass per Python file (inside ``mapInArrow``) emits
class, base, field, method, member and import rows; relations between classes are joins.

A class is known by its file and name. A name in a base or a type is looked up in its own file,
then through the file's imports; what neither holds is external and keeps its full dotted name.
Pass a written table of mined rows (``cut_lineage``) to the relations, so files are parsed once.

The analysed code is parsed, never imported or executed. A file that does not parse yields
one ``error`` row.
"""

from __future__ import annotations

import ast
import builtins

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.code import parse_files
from textloom.functions.text import _c
from textloom.operators.predicates import public_member
from textloom.session import cut_lineage, cut_lineage_counted

MINED_SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("kind", T.StringType()),  # class | base | field | method | member | import | error
        T.StructField("class_name", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("detail", T.StringType()),  # base: dotted name; field: type text; method: signature; import: module
        T.StructField("shape", T.StringType()),  # field: name | list | union | other
        T.StructField("elements", T.ArrayType(T.StringType())),
        T.StructField("pos", T.IntegerType()),
    ]
)

# Constructor parameters that are not fields; enum and protocol base names.
SKIPPED_PARAMS = ("self", "cls", "args", "kwargs")
ENUM_BASES = ("Enum", "IntEnum", "StrEnum", "Flag", "IntFlag")
PROTOCOL_BASES = ("Protocol",)
# Python's own exception classes, from the running interpreter.
EXCEPTION_BASES = tuple(sorted(n for n, v in vars(builtins).items() if isinstance(v, type) and issubclass(v, BaseException)))


def _dotted(n):
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        inner = _dotted(n.value)
        return f"{inner}.{n.attr}" if inner else n.attr
    if isinstance(n, ast.Subscript):
        return _dotted(n.value)
    if isinstance(n, ast.Constant) and isinstance(n.value, str):
        return n.value
    return None


def _shape(ann):
    # X | Y or Union[X, Y] / Optional[X] → union; any other generic → list of its first argument
    if isinstance(ann, ast.BinOp) and isinstance(ann.op, ast.BitOr):
        parts, stack = [], [ann]
        while stack:
            a = stack.pop()
            if isinstance(a, ast.BinOp) and isinstance(a.op, ast.BitOr):
                stack.extend([a.right, a.left])
            else:
                parts.append(_dotted(a) or ast.unparse(a))
        return "union", parts
    if isinstance(ann, ast.Subscript):
        base = _dotted(ann.value) or ""
        sl = ann.slice
        args = list(sl.elts) if isinstance(sl, ast.Tuple) else [sl]
        if base.split(".")[-1] in ("Union", "Optional"):
            return "union", [_dotted(a) or ast.unparse(a) for a in args]
        return "list", [_dotted(args[0]) or ast.unparse(args[0])]
    return "name", [_dotted(ann) or ast.unparse(ann)]


def _mine_file(path: str, code: str):
    rows = []
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError) as e:
        return [(path, "error", None, None, f"{type(e).__name__}: {e}", None, None, 0)]

    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:  # "import a.b" binds a; "import a.b as c" binds c to a.b
                rows.append((path, "import", None, a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], None, None, 0))
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                rows.append((path, "import", None, a.asname or a.name, "." * n.level + (n.module or ""), None, [a.name], 0))
    classes = sorted((n for n in tree.body if isinstance(n, ast.ClassDef)), key=lambda c: c.name)
    for ci, c in enumerate(classes):
        rows.append((path, "class", c.name, c.name, None, None, None, ci))
        for bi, b in enumerate(c.bases):
            d = _dotted(b)
            rows.append((path, "base", c.name, (d or "").split(".")[-1], d, None, None, bi))
        fields: dict[str, tuple] = {}
        init = next((n for n in c.body if isinstance(n, ast.FunctionDef) and n.name == "__init__"), None)
        if init is not None:
            for a in init.args.args + init.args.kwonlyargs:
                if a.arg in SKIPPED_PARAMS:
                    continue
                if a.annotation is not None:
                    sh, el = _shape(a.annotation)
                    fields[a.arg] = (ast.unparse(a.annotation), sh, el)
                else:
                    fields[a.arg] = (None, "other", [])
        for n in c.body:
            if isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                sh, el = _shape(n.annotation)
                fields[n.target.id] = (ast.unparse(n.annotation), sh, el)
        for fi, (fname, (ftype, sh, el)) in enumerate(fields.items()):
            rows.append((path, "field", c.name, fname, ftype, sh, el, fi))
        mi = 0
        for n in c.body:
            for t in n.targets if isinstance(n, ast.Assign) else ():
                if isinstance(t, ast.Name):
                    vt = type(n.value.value).__name__ if isinstance(n.value, ast.Constant) else None
                    rows.append((path, "member", c.name, t.id, vt, None, None, mi))
                    mi += 1
        for mi, n in enumerate(x for x in c.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))):
            rows.append((path, "method", c.name, n.name, f"{n.name}({ast.unparse(n.args)})", None, None, mi))
    return rows


def mine_structure(files: DataFrame, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """One parse per file → rows of MINED_SCHEMA (I1–I5 in one pass)."""
    return files.select(path_col, content_col).mapInArrow(lambda batches: parse_files(batches, _mine_file, MINED_SCHEMA), MINED_SCHEMA)


def class_kind(name, is_protocol, is_enum, is_exception) -> Column:
    """Ordered naming / ancestry rules (B16)."""
    n = _c(name)
    return (
        F.when(n.endswith("If"), F.lit("INTERFACE"))
        .when(_c(is_protocol), F.lit("INTERFACE"))
        .when(n.startswith("Abstract"), F.lit("ABSTRACT"))
        .when(n.endswith("Mixin"), F.lit("MIXIN"))
        .when(n.endswith("Base"), F.lit("BASE"))
        .when(_c(is_enum), F.lit("ENUM"))
        .when(_c(is_exception), F.lit("EXCEPTION"))
        .when(n.endswith("Entity"), F.lit("ENTITY"))
        .otherwise(F.lit("VALUE_OBJECT"))
    )


def _module_dir(path: Column, level: Column) -> Column:
    """Folder that a relative import of ``level`` dots starts from."""
    parts = F.split(path, "/", -1)
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0))), "/")


def class_refs(mined: DataFrame, refs: DataFrame) -> DataFrame:
    """Resolve dotted names. ``refs`` holds (path, ref, ...); added are ``to_path`` and ``to_class`` of
    the analysed class that the name means, or null, and ``external``, its full dotted name otherwise."""
    classes = mined.where(F.col("kind") == "class").select(F.col("path").alias("to_path"), F.col("class_name").alias("to_class")).distinct()
    imports = mined.where(F.col("kind") == "import").groupBy("path", F.col("name").alias("head")).agg(
        F.max(F.struct("detail", F.col("elements")[0].alias("orig"))).alias("imp")
    )
    names = refs.select("path", "ref").distinct().withColumn("head", F.substring_index("ref", ".", 1))
    rest = F.expr("substr(ref, length(head) + 1)")  # ".C" of "mod.C"
    own = names.join(classes.select(F.col("to_path").alias("path"), F.col("to_class").alias("ref"), F.lit(True).alias("own")), ["path", "ref"], "left")
    imported = own.join(imports, ["path", "head"], "left")
    module, orig = F.col("imp.detail"), F.col("imp.orig")
    stem = F.regexp_replace(module, r"^\.+", "")
    full = F.concat_ws(".", F.when(stem != "", stem), orig)
    dots = F.length(F.regexp_extract(module, r"^(\.*)", 1))
    dotted = F.when(F.col("imp").isNull(), F.col("ref")).otherwise(F.concat(full, rest))
    last = F.substring_index(dotted, ".", -1)
    inside = F.length(dotted) - F.length(last) - 1
    folder = F.replace(F.when(inside > 0, dotted.substr(F.lit(1), inside)).otherwise(F.lit("")), F.lit("."), F.lit("/"))
    base = F.when(dots > 0, F.concat_ws("/", F.when(_module_dir(F.col("path"), dots) != "", _module_dir(F.col("path"), dots)), F.when(folder != "", folder))).otherwise(folder)
    found = imported.select("path", "ref", "own", dotted.alias("dotted"), last.alias("last"), F.when(F.col("imp").isNotNull(), base).alias("module_path"))
    probe = found.withColumn("to_path", F.explode(F.array(F.concat("module_path", F.lit(".py")), F.concat("module_path", F.lit("/__init__.py")))))
    known = classes.withColumnRenamed("to_class", "last")
    there = probe.where("own is null").join(known, ["to_path", "last"])
    there = there.groupBy("path", "ref").agg(F.min(F.struct("to_path", F.col("last").alias("to_class"))).alias("there"))
    out = found.join(there, ["path", "ref"], "left").select(
        "path", "ref",
        F.when(F.col("own"), F.col("path")).otherwise(F.col("there.to_path")).alias("to_path"),
        F.when(F.col("own"), F.col("ref")).otherwise(F.col("there.to_class")).alias("to_class"),
        F.when(F.col("own").isNull() & F.col("there").isNull(), F.col("dotted")).alias("external"),
    )
    return refs.join(out, ["path", "ref"])


def base_refs(mined: DataFrame) -> DataFrame:
    """(path, class_name, pos, ref, to_path, to_class, external) for every base."""
    return class_refs(mined, mined.where((F.col("kind") == "base") & F.col("detail").isNotNull()).select("path", "class_name", "pos", F.col("detail").alias("ref")))


def ancestors(bases: DataFrame) -> DataFrame:
    """(path, class_name, to_path, to_class, depth) for every analysed ancestor at its least depth, level
    by level until no new one appears."""
    edges = cut_lineage(bases.where("to_class is not null").select("path", "class_name", "to_path", "to_class").distinct())
    level = seen = edges.withColumn("depth", F.lit(1))
    depth, n = 1, 1
    step = edges.select(F.col("path").alias("to_path"), F.col("class_name").alias("to_class"), F.col("to_path").alias("p"), F.col("to_class").alias("c"))
    while n:
        depth += 1
        nxt = level.join(step, ["to_path", "to_class"]).select("path", "class_name", F.col("p").alias("to_path"), F.col("c").alias("to_class"), F.lit(depth).alias("depth")).distinct()
        level, n = cut_lineage_counted(nxt.join(seen, ["path", "class_name", "to_path", "to_class"], "left_anti"))
        seen = seen.unionByName(level)
    return seen


def inherited_marks(bases: DataFrame, own: DataFrame) -> DataFrame:
    """``own(path, class_name, mark)``, distinct, with the same mark of every analysed class below. Marks go down from the classes
    that hold them, level by level until no class gets a new one; the rest of the ancestry is not followed."""
    edges = cut_lineage(bases.where("to_class is not null").select("path", "class_name", "to_path", "to_class").distinct())
    level, n = cut_lineage_counted(own)
    seen = level
    while n:
        above = level.select(F.col("path").alias("to_path"), F.col("class_name").alias("to_class"), "mark")
        nxt = edges.join(above, ["to_path", "to_class"]).select("path", "class_name", "mark").distinct()
        level, n = cut_lineage_counted(nxt.join(seen, ["path", "class_name", "mark"], "left_anti"))
        seen = seen.unionByName(level)
    return seen


def classes_with_kind(mined: DataFrame) -> DataFrame:
    """Classes with their kind; enum and exception ancestry follows bases through the analysed classes."""
    classes = mined.where(F.col("kind") == "class").select("path", "class_name").distinct()
    bases = cut_lineage(base_refs(mined))
    last = F.substring_index("external", ".", -1)
    held = F.array_compact(F.array(
        F.when(last.isin(*ENUM_BASES), F.lit("is_enum")), F.when(F.col("external").isin(*EXCEPTION_BASES), F.lit("is_exception")),
        F.when(last.isin(*PROTOCOL_BASES), F.lit("is_protocol")),
    ))
    direct = cut_lineage(bases.select("path", "class_name", F.explode(held).alias("mark")).distinct())
    protocol = F.col("mark") == "is_protocol"  # holds for the class itself only
    marks = inherited_marks(bases, direct.where(~protocol)).unionByName(direct.where(protocol))
    names = ["is_enum", "is_exception", "is_protocol"]
    flags = marks.groupBy("path", "class_name").agg(*[F.max(F.col("mark") == c).alias(c) for c in names])
    out = classes.join(flags, ["path", "class_name"], "left").fillna(False, names)
    return out.withColumn("class_type", class_kind("class_name", "is_protocol", "is_enum", "is_exception"))


def enum_members(mined: DataFrame) -> DataFrame:
    """(path, class_name, name, value_type) of the classes that are enums, by whatever ancestor (I3)."""
    enums = classes_with_kind(mined).where("is_enum").select("path", "class_name")
    members = mined.where(F.col("kind") == "member").select("path", "class_name", "name", F.col("detail").alias("value_type"))
    return members.join(enums, ["path", "class_name"], "left_semi")


def inherit_edges(mined: DataFrame, analysed: DataFrame | None = None, root: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(path, class_name, base_path, base) where the base is one of the mined classes (D8).

    ``analysed`` (path) names the files whose classes are analysed, all mined ones without it. A base outside
    them counts where its path begins with ``root`` and with none of ``ignore``; without a root it does not."""
    refs = base_refs(mined).where("to_class is not null")
    edges = refs.select("path", "class_name", F.col("to_path").alias("base_path"), F.col("to_class").alias("base")).distinct()
    if analysed is None:
        return edges
    files = analysed.select("path").distinct()
    edges = edges.join(files, "path", "left_semi")
    edges = edges.join(files.select(F.col("path").alias("base_path"), F.lit(True).alias("__in")), "base_path", "left")
    counts = F.col("__in").isNotNull()
    if root is not None:
        under = F.col("base_path").startswith(root)
        for prefix in ignore:
            under &= ~F.col("base_path").startswith(prefix)
        counts |= under
    return edges.where(counts).select("path", "class_name", "base_path", "base")


def inherit_lines(mined: DataFrame, analysed: DataFrame | None = None, root: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """:func:`inherit_edges` with ``line``: dotted where the base is an interface, else solid."""
    kinds = classes_with_kind(mined).select(F.col("path").alias("base_path"), F.col("class_name").alias("base"), "class_type")
    line = F.when(F.col("class_type") == "INTERFACE", F.lit("dotted")).otherwise(F.lit("solid"))
    edges = inherit_edges(mined, analysed, root, ignore).join(kinds, ["base_path", "base"], "left")
    return edges.select("path", "class_name", "base_path", "base", line.alias("line"))


def compose_edges(mined: DataFrame) -> DataFrame:
    """Field type → analysed class: plain type multiplicity ``1``, list element or union
    member ``0..*``; distinct (D9)."""
    f = mined.where(F.col("kind") == "field").select("path", "class_name", "shape", F.explode("elements").alias("ref"))
    mult = F.when(F.col("shape") == "name", F.lit("1")).otherwise(F.lit("0..*"))
    refs = class_refs(mined, f).where("to_class is not null")
    return refs.select("path", "class_name", F.col("to_path").alias("target_path"), F.col("to_class").alias("target"), mult.alias("multiplicity")).distinct()


def own_fields(mined: DataFrame) -> DataFrame:
    """Fields not already declared with the same (name, type) on an analysed direct base (D10)."""
    fields = mined.where(F.col("kind") == "field").select("path", "class_name", "name", F.col("detail").alias("type"), "pos")
    there = fields.select(F.col("path").alias("base_path"), F.col("class_name").alias("base"), F.col("name").alias("b_name"), F.col("type").alias("b_type"))
    held = inherit_edges(mined).join(there, ["base_path", "base"]).select(F.col("path").alias("b_path"), F.col("class_name").alias("b_class"), "b_name", "b_type")
    cond = (F.col("path") == F.col("b_path")) & (F.col("class_name") == F.col("b_class")) & (F.col("name") == F.col("b_name")) & F.col("type").eqNullSafe(F.col("b_type"))
    return fields.join(held, cond, "left_anti")


def methods_for(mined: DataFrame, display: str = "defined", public_only: bool = True) -> DataFrame:
    """Methods to show per class (B10, B11): ``hide`` → none; ``defined`` → methods whose
    defining class is exactly the class; ``all`` → also those of all analysed ancestors, the
    nearest definition of a name only."""
    m = mined.where(F.col("kind") == "method").select("path", "class_name", "name", F.col("detail").alias("signature"), "pos")
    if public_only:
        m = m.where(public_member("name"))
    if display == "hide":
        return m.limit(0)
    own = m.withColumn("defined_path", F.col("path")).withColumn("defined_in", F.col("class_name"))
    if display == "defined":
        return own
    there = m.select(F.col("path").alias("to_path"), F.col("class_name").alias("to_class"), "name", "signature", "pos")
    above = ancestors(base_refs(mined)).join(there, ["to_path", "to_class"]).select(
        "path", "class_name", "name", "signature", "pos", F.col("to_path").alias("defined_path"), F.col("to_class").alias("defined_in"), "depth"
    )
    every = own.withColumn("depth", F.lit(0)).unionByName(above)
    nearest = Window.partitionBy("path", "class_name", "name").orderBy("depth", "defined_path", "defined_in", F.col("pos").desc())
    return every.withColumn("__n", F.row_number().over(nearest)).where("__n = 1").drop("__n", "depth")


def class_inventory(mined: DataFrame) -> DataFrame:
    """Class with nested fields and methods (E11): ``array<struct>`` columns."""
    keys = ["path", "class_name"]
    c = mined.where(F.col("kind") == "class").select(*keys).distinct()
    f = own_fields(mined).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))).alias("fields"))
    m = methods_for(mined, "defined").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "signature"))).alias("methods"))
    return c.join(f, keys, "left").join(m, keys, "left")
