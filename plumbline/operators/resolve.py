"""Imports, includes and packages to files: ranked candidates, an equi-join with an index, and the best that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.operators.tables import fresh, written


def _joined(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).when(rest == "", folder).otherwise(F.concat_ws("/", folder, rest))


def _folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def _below_tops(paths: DataFrame, tops: DataFrame) -> DataFrame:
    """(rel, places): names below the folders of top-level packages, each with the two files that go first by the folder's depth and name.

    So an import looks its name up once, and is not paired with every package of that name; the second file answers the
    first one's own imports.
    """
    parts = F.split("path", "/")
    cut = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("root"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/").alias("rel")))
    below = paths.select("path", F.explode(cut).alias("c")).select(F.col("path").alias("target"), "c.*").withColumn("first", F.regexp_replace(F.regexp_extract("rel", "^[^/]*", 0), r"\.py$", ""))
    known = below.join(tops.select("root", "first").distinct(), ["root", "first"], "left_semi")
    place = F.row_number().over(Window.partitionBy("rel").orderBy("depth", "root"))
    return known.withColumn("_p", place).where("_p <= 2").groupBy("rel").agg(F.sort_array(F.collect_list(F.struct("depth", "root", "target"))).alias("places"))


def resolve_python(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, specifier, ...) with target and resolution: internal, unresolved or external.

    Names are looked up as a module, a package, and then without their last part, which may be a name inside. Relative
    names start from their folder. Absolute ones start from the importing file's folders that are no packages, the
    nearest first, then from the folders of top-level packages with that name, the least deep first; they never
    resolve to the file itself, and are external unless their first part is analysed.
    """
    paths = files.select("path").distinct()
    packages = paths.where("path rlike '(^|/)__init__[.]py$'").select(_folder(F.col("path")).alias("folder"))
    above = packages.withColumn("above", _folder(F.col("folder")))
    tops = above.join(packages.select(F.col("folder").alias("above")), "above", "left_anti").select(F.col("above").alias("root"), F.regexp_extract("folder", "[^/]*$", 0).alias("first"))

    names = imports.columns
    folder = fresh("_dir", names)
    spec = F.regexp_replace("specifier", r"\.\*$|^(\.+)\*$", "$1")
    dots = F.length(F.regexp_extract("specifier", r"^\.*", 0))
    # answers depend on a file's folder and not on the file, but for the file itself, which the second best target stands for
    asking = written(imports.select(_folder(F.col("path")).alias("dir"), "specifier").where("dir is not null and specifier is not null").distinct(), "imports")
    base = asking.withColumn("dots", dots).withColumn("rest", F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/")))
    parts = F.when(F.col("dir") == "", F.array().cast("array<string>")).otherwise(F.split("dir", "/"))

    near = base.where("dots > 0").withColumn("p", parts).where("size(p) >= dots - 1").select("dir", "specifier", "rest", "dots", F.array_join(F.slice("p", 1, F.size("p") - F.col("dots") + 1), "/").alias("root"), F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")).alias("rank"))
    absolute = base.where("dots = 0")
    ups = absolute.withColumn("p", parts).select("dir", "specifier", "rest", "dots", "p", F.explode(F.sequence(F.lit(0), F.size("p"))).alias("up"))
    own = ups.select("dir", "specifier", "rest", "dots", F.array_join(F.slice("p", 1, F.size("p") - F.col("up")), "/").alias("root"), F.struct(F.lit(0).alias("a"), F.col("up").alias("b"), F.lit("").alias("c")).alias("rank"))
    own = own.join(packages.withColumnRenamed("folder", "root"), "root", "left_anti").select(near.columns)
    parent = F.regexp_replace("rest", "/?[^/]*$", "")
    may_drop = (F.col("rest") != "") & ((F.col("dots") > 0) | F.col("rest").contains("/"))
    first = F.regexp_extract("rest", "^[^/]*", 0)
    ways = [(1, F.col("rest"), F.lit(True), ".py"), (2, F.col("rest"), F.lit(True), "/__init__.py"), (3, parent, may_drop, ".py"), (4, parent, may_drop, "/__init__.py"), (9, first, F.col("dots") == 0, ".py"), (9, first, F.col("dots") == 0, "/__init__.py")]

    def place(names: Column, end: str) -> Column:
        folder = _joined(F.col("root"), names)
        file = F.when(folder == "", F.lit(end.lstrip("/"))).otherwise(F.concat(folder, F.lit(end)))
        return F.when((names == "") & F.lit(end == ".py"), F.lit(None)).otherwise(file)

    each = F.explode(F.array(*[F.struct(F.lit(n).alias("way"), F.when(ok, place(names, end)).alias("target")) for n, names, ok, end in ways])).alias("t")
    tried = near.unionByName(own).select("dir", "specifier", "rank", each).select("dir", "specifier", "rank", "t.way", "t.target").where("target is not null")
    there = paths.select(F.col("path").alias("target")).join(tried.select("target").distinct(), "target", "left_semi").withColumn("_there", F.lit(True))
    exists = _salted(tried, there, ["target"], ["dir", "specifier"]).where("_there").select("dir", "specifier", "rank", "way", "target")
    asked = absolute.select("specifier", "rest", "dots").distinct().withColumn("root", F.lit("")).select("specifier", each).select("specifier", "t.way", F.col("t.target").alias("rel")).where("rel is not null")
    below = _below_tops(paths, tops).join(asked.select("rel").distinct(), "rel", "left_semi")
    far = _salted(asked, below, ["rel"], ["specifier"]).where("places is not null").select("specifier", "way", F.explode("places").alias("p"))
    found = far.groupBy("specifier").agg(F.collect_list(F.struct(F.struct(F.lit(1).alias("a"), F.col("p.depth").alias("b"), F.col("p.root").alias("c")).alias("rank"), "way", F.col("p.target").alias("target"))).alias("found"))
    far = _salted(absolute.select("dir", "specifier"), found, ["specifier"], ["dir"]).where("found is not null").select("dir", "specifier", F.explode("found").alias("f")).select("dir", "specifier", "f.*")
    each_target = exists.unionByName(far).groupBy("dir", "specifier", "target").agg(F.min(F.when(F.col("way") < 9, F.struct("rank", "way"))).alias("rank"), F.bool_or(F.col("way") == 9).alias("known"))
    best = each_target.groupBy("dir", "specifier").agg(F.slice(F.sort_array(F.collect_list(F.when(F.col("rank").isNotNull(), F.struct("rank", "target")))), 1, 2).alias("_best"), F.bool_or("known").alias("_known"))
    best = best.select(F.col("dir").alias(folder), "specifier", F.get("_best", 0)["target"].alias("_one"), F.get("_best", 1)["target"].alias("_two"), "_known")
    relative = F.col("specifier").startswith(".")
    target = F.when((F.col("_one") == F.col("path")) & ~relative, F.col("_two")).otherwise(F.col("_one"))
    joined = imports.withColumn(folder, _folder(F.col("path"))).join(best, [folder, "specifier"], "left").withColumn("target", target)
    kind = F.when(F.col("target").isNotNull(), "internal").when(relative | F.col("_known"), "unresolved").otherwise("external")
    return joined.withColumn("resolution", kind).select("path", "specifier", *[c for c in names if c not in ("path", "specifier")], "target", "resolution")


#: Salts of look-ups whose key may be that of most rows.
SALTS = 16


def _salted(asked: DataFrame, index: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """asked left join index on the columns on; a key that most of asked has is dealt to SALTS tasks. index has a row for each key.

    It is a merge join whatever Spark makes of sizes: it takes no notice of the copies, and would broadcast all of them.
    """
    wide = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    return asked.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).join(wide, [*on, "_salt"], "left").drop("_salt")


def clean_path(path: Column) -> Column:
    """A path without empty parts, `.` and, where something stands before it, `..`; a leading slash stays."""
    rooted = path.startswith("/")

    def step(kept: Column, part: Column) -> Column:
        up = F.coalesce(F.try_element_at(kept, F.lit(-1)) != "..", F.lit(False))
        back = F.when(up, F.slice(kept, 1, F.size(kept) - 1)).when(rooted, kept).otherwise(F.concat(kept, F.array(part)))
        return F.when((part == "") | (part == "."), kept).when(part == "..", back).otherwise(F.concat(kept, F.array(part)))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))


def suffix_index(files: DataFrame) -> DataFrame:
    """files (path) -> (name, n, low, high, whole) for every trailing path of a file: how many end in it, the first and last of them, and whether it is one."""
    parts = F.split("path", "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    names = files.select("path").distinct().select("path", F.explode(every).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("low"), F.max("path").alias("high"), F.bool_or(F.col("name") == F.col("path")).alias("whole"))


def resolve_includes(includes: DataFrame, files: DataFrame) -> DataFrame:
    """includes (path, specifier) with target and resolution: internal, unresolved or external.

    A quoted name is looked up beside its file, then from the root, then as the one file whose path ends in it; a name in
    angle brackets likewise but for the first, and without a folder it is external. More than one file that ends in it:
    unresolved. A file never includes itself. files are the C and C++ files to be found. The suffixes of all paths are
    one index with counts, so a name that many files end in is one row of it; a null or too short specifier is external.
    """
    spec = F.regexp_replace(F.expr("substring(specifier, 2, length(specifier) - 2)"), r"\\", "/")
    base = includes.select("path", "specifier").distinct().where(F.length("specifier") >= 3)
    named = base.withColumn("quoted", F.col("specifier").startswith('"')).withColumn("name", clean_path(spec))
    near = F.when(F.col("quoted"), clean_path(F.concat_ws("/", _folder(F.col("path")), spec)))
    open_to_all = F.when(F.col("quoted") | F.col("name").contains("/"), F.col("name"))
    asked = named.select("path", "specifier", F.explode(F.array(F.struct(F.lit(1).alias("way"), near.alias("name")), F.struct(F.lit(2).alias("way"), open_to_all.alias("name")))).alias("a")).select("path", "specifier", "a.*").where("name is not null")
    found = _salted(asked, suffix_index(files), ["name"], ["path"]).where("n is not null")
    itself, ends = F.col("path") == F.col("name"), (F.col("path") == F.col("name")) | F.col("path").endswith(F.concat(F.lit("/"), "name"))
    known = F.col("whole") & ~itself
    one_of = F.when(F.col("low") == F.col("path"), F.col("high")).otherwise(F.col("low"))
    # the including file may be one that ends in the name; whether it was analysed shows in the index only if it is low or high of one or two
    others = F.col("n") - F.when(ends & F.col("own"), 1).otherwise(0)
    mine = files.select("path").distinct().withColumn("own", F.lit(True))
    found = found.join(mine, "path", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    beside = F.when((F.col("way") == 1) & known, F.struct(F.lit(1).alias("r"), F.col("name").alias("target")))
    root = F.when((F.col("way") == 2) & known, F.struct(F.lit(2).alias("r"), F.col("name").alias("target")))
    tail = F.when((F.col("way") == 2) & (others > 0), F.struct(F.when(others == 1, 3).otherwise(4).alias("r"), F.when(others == 1, one_of).alias("target")))
    best = found.groupBy("path", "specifier").agg(F.min(F.coalesce(beside, root, tail)).alias("best"))
    kind = F.when(F.col("best.r") <= 3, "internal").when(F.col("best.r") == 4, "unresolved").otherwise("external")
    return includes.join(best, ["path", "specifier"], "left").withColumn("target", F.col("best.target")).withColumn("resolution", kind).drop("best")


def _prefixes(parts: Column, sep: str, most: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), most), lambda n: F.array_join(F.slice(parts, 1, n), sep))


def nearest_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files (path) and modules (folder, module) -> (path, module, package): the module of the nearest folder above that has one, or nulls.

    The package is the module with the way down to the file's folder. Every folder is looked up once with all folders
    above it: one equi-join, of which the longest match counts. Of a folder with several modules the smallest is taken.
    """
    folders = files.select(_folder(F.col("path")).alias("folder")).distinct()
    parts = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(F.split("folder", "/"))
    above = folders.select("folder", F.explode(_prefixes(parts, "/", F.size(parts))).alias("above"))
    index = modules.groupBy(F.col("folder").alias("above")).agg(F.min("module").alias("module"))
    found = _salted(above, index, ["above"], ["folder"]).where("module is not null")
    best = found.groupBy("folder").agg(F.max(F.struct(F.length("above").alias("n"), "above", "module")).alias("b"))
    rest = F.expr("substring(folder, if(b.n = 0, 1, b.n + 2))")
    named = best.select("folder", F.col("b.module").alias("module"), F.when(rest == "", F.col("b.module")).otherwise(F.concat("b.module", F.lit("/"), rest)).alias("package"))
    return files.select("path", _folder(F.col("path")).alias("folder")).join(named, "folder", "left").select("path", "module", "package")


def resolve_packages(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, specifier) by module rules, with target and resolution; files (path, module, package) of nearest_modules().

    A package is imported by its first file in the order of names that is no test. What begins with an analysed module and
    is no package is unresolved, all else external.
    """
    known = files.where("module is not null")
    packages = known.where(~F.col("path").endswith("_test.go")).groupBy(F.col("package").alias("specifier")).agg(F.min("path").alias("target"))
    parts = F.split("specifier", "/")
    asked = imports.select("specifier").where("specifier is not null").distinct()
    roots = known.select(F.col("module").alias("prefix")).distinct()
    inside = asked.select("specifier", F.explode(_prefixes(parts, "/", F.size(parts))).alias("prefix")).join(roots, "prefix", "left_semi").select("specifier").distinct().withColumn("_inside", F.lit(True))
    answers = asked.join(packages, "specifier", "left").join(inside, "specifier", "left")
    kind = F.when(F.col("target").isNotNull(), "internal").when(F.col("_inside"), "unresolved").otherwise("external")
    joined = _salted(imports, answers.withColumn("_kind", kind).drop("_inside"), ["specifier"], ["path"])
    return joined.withColumn("resolution", F.coalesce("_kind", F.lit("external"))).drop("_kind")


def resolve_classes(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (path, specifier, kind, seq) by package declarations, with target and resolution; files are (path, package).

    A declared name is split into a package and a class from the longest package on, so that nested classes and static
    members resolve; several folders of one package are taken in order. A name of a known package that has no such class is
    unresolved, `.*` and all else external. A name of kind implicit that has dots is looked up likewise, then its first
    part in the file's own folder, in the other folders of its package, and in the packages that the file imports with
    `.*`, in the order of seq; it is never unresolved. No file resolves to itself.
    """
    name = F.regexp_extract("path", r"([^/]*)\.java$", 1)
    sources = files.where(F.col("path").endswith(".java")).select("path", _folder(F.col("path")).alias("folder"), F.coalesce("package", F.lit("")).alias("package"))
    folders = sources.select("package", "folder").distinct()
    classes = sources.select("folder", "path", name.alias("class")).distinct()
    # of each class of a package the two first files answer every question, as one of them may be the one that asks
    place = F.row_number().over(Window.partitionBy("package", "class").orderBy("folder"))
    index = folders.join(classes, "folder").withColumn("_p", place).where("_p <= 2").groupBy("package", "class").agg(F.sort_array(F.collect_list(F.struct("folder", "path"))).alias("places"))

    asked = imports.select("path", "specifier", "kind").distinct().where("specifier is not null and not endswith(specifier, '.*')")
    parts, implicit = F.split("specifier", r"\."), F.col("kind") == "implicit"
    split = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.lit(0).alias("way"), (-n).alias("a"), F.array_join(F.slice(parts, 1, n), ".").alias("package"), F.get(parts, n).alias("class")))
    named = asked.where(~implicit | (F.size(parts) > 1)).select("path", "specifier", "kind", F.explode(split).alias("q")).select("path", "specifier", "kind", "q.*")
    hidden = asked.where(implicit).withColumn("class", F.get(parts, 0))
    declared = files.select("path", F.coalesce("package", F.lit("")).alias("package")).distinct()
    same = hidden.join(declared, "path").select("path", "specifier", "kind", F.lit(2).alias("way"), F.lit(0).alias("a"), "package", "class")
    stars = imports.where("endswith(specifier, '.*')").select("path", F.col("seq").cast("int").alias("a"), F.expr("substring(specifier, 1, length(specifier) - 2)").alias("package"))
    starred = hidden.join(stars, "path").select("path", "specifier", "kind", F.lit(3).alias("way"), "a", "package", "class")
    tried = _salted(named.unionByName(same).unionByName(starred), index, ["package", "class"], ["path", "specifier"]).where("places is not null")
    first = F.get(F.filter("places", lambda x: x["path"] != F.col("path")), 0)
    tried = tried.withColumn("first", first).where("first is not null").select("path", "specifier", "kind", F.struct("way", "a", F.col("first.folder").alias("folder"), F.col("first.path").alias("target")).alias("rank"))
    beside = hidden.withColumn("_folder", _folder(F.col("path"))).withColumn("_at", F.when(F.col("_folder") == "", F.concat("class", F.lit(".java"))).otherwise(F.concat("_folder", F.lit("/"), "class", F.lit(".java"))))
    own = beside.join(files.select(F.col("path").alias("_at")).distinct(), "_at").where(F.col("_at") != F.col("path")).select("path", "specifier", "kind", F.struct(F.lit(1).alias("way"), F.lit(0).alias("a"), F.col("_folder").alias("folder"), F.col("_at").alias("target")).alias("rank"))
    best = tried.unionByName(own).groupBy("path", "specifier", "kind").agg(F.min("rank")["target"].alias("target"))
    outer = F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")
    packages = folders.select("package").distinct()
    known = asked.where(~implicit & (F.size(parts) > 1)).select("path", "specifier", "kind", outer.alias("package")).join(packages, "package", "left_semi").select("path", "specifier", "kind").withColumn("_known", F.lit(True))
    joined = imports.join(best, ["path", "specifier", "kind"], "left").join(known, ["path", "specifier", "kind"], "left")
    kind = F.when(F.col("target").isNotNull(), "internal").when(F.col("_known"), "unresolved").otherwise("external")
    return joined.withColumn("resolution", kind).drop("_known")
