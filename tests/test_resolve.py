"""Includes, modules, packages and classes to files, against plain look-ups in the same order."""

import posixpath
import random

from plumbline.operators import graph, resolve


def answers(df):
    return {tuple(r[c] for c in df.columns if c not in ("target", "resolution")): (r["resolution"], r["target"]) for r in df.collect()}


def include(path, specifier, files):
    if specifier is None or len(specifier) < 3:
        return "external", None
    quoted, name = specifier[0] == '"', posixpath.normpath(specifier[1:-1].replace("\\", "/"))
    if quoted and (near := posixpath.normpath(posixpath.join(posixpath.dirname(path), name))) in files and near != path:
        return "internal", near
    if not quoted and "/" not in name:
        return "external", None
    if name in files and name != path:
        return "internal", name
    ends = [f for f in files if f != path and (f == name or f.endswith("/" + name))]
    return ("external", None) if not ends else ("internal", ends[0]) if len(ends) == 1 else ("unresolved", None)


def test_includes(spark):
    r = random.Random(7)
    files = {"src/net/socket.c", "src/net/socket.h", "src/util/log.h", "include/project/api.h", "lib/a/config.h", "lib/b/config.h", "string.h", "a.h", "b/a.h"}
    files |= {"/".join(r.choice("abc") for _ in range(r.randrange(1, 4))) + ".h" for _ in range(25)}
    names = ["socket.h", "../util/log.h", "util/log.h", "src/util/log.h", "project/api.h", "log.h", "config.h", "string.h", "openssl/ssl.h", "generated.h", "socket.c", "..\\util\\log.h", "./a.h", "a//b.h", "../../../x.h", "b/../a.h"]
    names += ["/".join(r.choice(["a", "b", "c", "..", "."]) for _ in range(r.randrange(1, 4))) + ".h" for _ in range(40)]
    sources = sorted(files)[::3] + ["src/net/socket.c", "gone/x.c", "top.c"]
    rows = [(p, f'"{n}"') for p in sources for n in names] + [(p, f"<{n}>") for p in sources for n in names] + [("top.c", None), ("top.c", '""'), ("top.c", '"')]
    rows = sorted(set(rows), key=str)
    got = answers(resolve.resolve_includes(spark.createDataFrame(rows, "path string, specifier string"), spark.createDataFrame([(f,) for f in files], "path string")))
    assert got == {x: include(*x, files) for x in rows}
    assert got["src/net/socket.c", '"config.h"'] == ("unresolved", None) and got["src/net/socket.c", "<string.h>"] == ("external", None) and got["src/net/socket.c", '"log.h"'] == ("internal", "src/util/log.h")


def test_modules_and_packages(spark):
    files = ["main.go", "a/x.go", "a/x_test.go", "a/b/y.go", "a/b/c/z.go", "tools/t.go", "tools/deep/er/u.go", "z_test.go"]
    modules = spark.createDataFrame([("a", "example.org/a"), ("a/b", "example.org/a/b2"), ("tools", "tools.org"), ("tools", "zzz")], "folder string, module string")
    found = resolve.nearest_modules(spark.createDataFrame([(f,) for f in files], "path string"), modules)
    got = {r["path"]: (r["module"], r["package"]) for r in found.collect()}
    assert got == {"main.go": (None, None), "z_test.go": (None, None), "a/x.go": ("example.org/a",) * 2, "a/x_test.go": ("example.org/a",) * 2, "a/b/y.go": ("example.org/a/b2",) * 2, "a/b/c/z.go": ("example.org/a/b2", "example.org/a/b2/c"), "tools/t.go": ("tools.org",) * 2, "tools/deep/er/u.go": ("tools.org", "tools.org/deep/er")}
    root = resolve.nearest_modules(spark.createDataFrame([("x.go",), ("a/y.go",)], "path string"), spark.createDataFrame([("", "r.org")], "folder string, module string"))
    assert {r["path"]: r["package"] for r in root.collect()} == {"x.go": "r.org", "a/y.go": "r.org/a"}
    specs = ["example.org/a", "example.org/a/b2", "example.org/a/b2/c", "example.org/a/none", "example.org/ab", "fmt", "tools.org/deep", None]
    imports = spark.createDataFrame([("main.go", s) for s in specs], "path string, specifier string")
    answer = {r["specifier"]: (r["resolution"], r["target"]) for r in resolve.resolve_packages(imports, found).collect()}
    assert answer == {"example.org/a": ("internal", "a/x.go"), "example.org/a/b2": ("internal", "a/b/y.go"), "example.org/a/b2/c": ("internal", "a/b/c/z.go"), "example.org/a/none": ("unresolved", None), "example.org/ab": ("external", None), "fmt": ("external", None), "tools.org/deep": ("unresolved", None), None: ("external", None)}


def java(path, specifier, kind, files, stars):
    folders = {}
    for f, p in files.items():
        if f.endswith(".java"):
            folders.setdefault(p or "", set()).add(posixpath.dirname(f))

    def at(folder, name):
        target = posixpath.join(folder, name + ".java")
        return target if target in files and target != path else None

    def qualified(parts):
        for n in range(len(parts) - 1, -1, -1):
            for folder in sorted(folders.get(".".join(parts[:n]), ())):
                if hit := at(folder, parts[n]):
                    return hit

    if specifier is None or specifier.endswith(".*"):
        return "external", None
    parts = specifier.split(".")
    if kind != "implicit":
        if hit := qualified(parts):
            return "internal", hit
        return ("unresolved" if len(parts) > 1 and ".".join(parts[:-1]) in folders else "external"), None
    hit = qualified(parts) if len(parts) > 1 else None
    own = posixpath.dirname(path)
    places = [own] + sorted(folders.get(files.get(path) or "", set()) - {own})
    for star in stars.get(path, []):
        places += sorted(folders.get(star, ()))
    for folder in places:
        hit = hit or at(folder, parts[0])
    return ("internal", hit) if hit else ("external", None)


def test_classes(spark):
    r = random.Random(11)
    names, packages = ["A", "B", "C", "Util"], ["p", "p.q", "p.q.r", "x", None]
    files = {}
    for _ in range(30):
        package = r.choice(packages)
        folder = r.choice(["main/", "test/", ""]) + (package or "").replace(".", "/")
        files[posixpath.join(folder, r.choice(names) + ".java")] = package
    files["notes.txt"] = "p"
    sources = sorted(f for f in files if f.endswith(".java"))
    stars, rows = {}, []
    for f in sources:
        for seq in range(6):
            kind = r.choice(["static", "implicit"])
            rows.append((f, ".".join(r.choice(["p", "q", "r", "x", *names]) for _ in range(r.randrange(1, 4))), kind, seq))
        if r.random() < 0.6:
            chosen = r.sample(["p", "p.q", "x", "none"], 2)
            stars[f] = chosen
            rows += [(f, c + ".*", "static", 10 + i) for i, c in enumerate(chosen)]
    rows.append((sources[0], None, "static", 99))
    imports = spark.createDataFrame(rows, "path string, specifier string, kind string, seq int")
    got = answers(resolve.resolve_classes(imports, spark.createDataFrame(list(files.items()), "path string, package string")))
    assert {k: v for k, v in got.items()} == {x: java(*x[:3], files, stars) for x in rows}
    assert len({v[0] for v in got.values()}) == 3


def test_files_of_a_folder_share_their_look_ups(spark, monkeypatch):
    """300 files of a folder import the same three names, one of them the file of that name too, and each gets its own answers."""
    asked, real = [], resolve.written
    monkeypatch.setattr(resolve, "written", lambda df, tag: asked.append(real(df, tag)) or asked[-1])
    files = spark.createDataFrame([(f"src/m{i}.py",) for i in range(300)] + [("m7/__init__.py",)], "path string")
    imports = files.where("path like 'src/%'").selectExpr("path", "explode(array('m7', '.m8', 'os')) as specifier")
    got = {(r["path"], r["specifier"]): (r["target"], r["resolution"]) for r in resolve.resolve_python(imports, files).collect()}
    assert [a.count() for a in asked] == [3] and len(got) == 900
    assert got["src/m7.py", "m7"] == ("m7/__init__.py", "internal") and got["src/m9.py", "m7"] == ("src/m7.py", "internal")
    assert got["src/m8.py", ".m8"] == ("src/m8.py", "internal") and got["src/m8.py", "os"] == (None, "external")


def test_copies_of_an_index_are_not_broadcast(spark):
    """An index has a copy for each salt, of which Spark's estimate knows nothing; external imports are counted without one of them on the driver."""
    asked = spark.createDataFrame([("a", "x"), ("b", "y")], "path string, name string")
    index = spark.createDataFrame([("x", 1)], "name string, n int")
    found = resolve._salted(asked, index, ["name"], ["path"])
    assert sorted((r["path"], r["n"]) for r in found.collect()) == [("a", 1), ("b", None)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    files = spark.createDataFrame([("a/__init__.py",), ("a/b.py",)], "path string")
    imports = spark.createDataFrame([("a/b.py", "a"), ("a/b.py", "os"), ("a/b.py", "sys")], "path string, specifier string")
    assert [r["message"] for r in graph.external_diagnostic(resolve.resolve_python(imports, files)).collect()] == ["2 imports are external"]
