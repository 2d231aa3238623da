from helpers import corpus, rows
from pyspark.sql import functions as F

from gatewright.operators.intel import entrypoints as ep
from gatewright.operators.intel import graph, imports, manifests
from gatewright.queries import scans
from gatewright.sources.tables import run_folder


def test_imports_and_edges(spark):
    tree, files = corpus(
        spark,
        {
            "r": {
                "src/index.test.ts": 'import { a } from "./index.js";\nimport { test } from "vitest";\n// import "x"\n',
                "src/index.ts": 'export const a = 1;\nimport { u } from "./util";\nimport z from "./none";\n',
                "src/util/index.ts": "export const u = 2;\n",
                "cmd/main.go": 'package main\nimport (\n  "fmt"\n  x "example.com/app/cmd"\n)\n',
                "pkg/a.py": "from . import (b,\n  c as d)\nimport os, json\n",
                "pkg/b.py": "x = 1\n",
                "src/lib.rs": "mod util;\nuse crate::util::go;\n",
                "src/util.rs": "use super::lib;\n",
            }
        },
    )
    prefixes = spark.createDataFrame([("r", "example.com/app")], "repo_id string, prefix string")
    found = imports.resolve_imports(imports.extract_imports(files), tree, None, prefixes)
    got = rows(found.where(F.col("kind") != "unresolved"), "path", "line", "specifier", "kind", "target")
    assert ("src/index.test.ts", 1, "./index.js", "file", "src/index.ts") in got
    assert ("src/index.test.ts", 2, "vitest", "external", "vitest") in got
    assert ("src/index.ts", 2, "./util", "file", "src/util/index.ts") in got
    assert ("cmd/main.go", 4, "example.com/app/cmd", "module", "cmd") in got
    assert ("pkg/a.py", 1, ".b", "file", "pkg/b.py") in got
    assert ("src/lib.rs", 1, "self::util", "file", "src/util.rs") in got
    assert not any(p == "src/index.ts" and s == "./none" for p, _, s, _, _ in got)
    edges = graph.dependency_edges(found)
    assert ("src/index.ts", "src/util/index.ts", 1) in rows(edges, "src", "dst", "weight")


def test_imports_ask_once(spark, tmp_path):
    tree, files = corpus(
        spark,
        {
            "r": {
                "src/a.ts": 'import "./x.js";\nimport "./dir";\nimport "./y.d";\nimport "pkg/deep";\nimport "root/lib/z";\nimport "./none";\n',
                "src/x.tsx": "", "src/x.js": "", "src/dir/index.js": "", "src/dir/index.ts": "", "src/y.d.ts": "", "lib/z.ts": "",
                "named/src/index.ts": "", "main.py": "import main\nimport src\nimport tool\nfrom . import index\n", "src/index.py": "", "index.py": "",
                "java/app/Main.java": "import app.Main;\nimport java.app.Main;\n", "src/app/Main.java": "", "tool/x.txt": "",
                "src/main/java/src/T.java": "import src.T;\nimport other.T;\n",
                "src/lib.rs": "use crate::index;\nmod index;\n", "src/index/mod.rs": "", "cmd/m.go": 'import "root/cmd"\nimport "root/gone"\n',
            },
            "q": {"src/a.ts": 'import "./x";\n'},
        },
    )
    modules = spark.createDataFrame([("r", "pkg", "named"), ("r", "tool", "tool")], "repo_id string, name string, path string")
    prefixes = spark.createDataFrame([("r", "root"), ("r", "root/")], "repo_id string, prefix string")
    extracted = imports.extract_imports(files)
    found = imports.resolve_imports(extracted, tree, modules, prefixes)
    got = {(r.repo_id, r.path, r.specifier): (r.kind, r.target) for r in found.collect()}
    want = {
        ("r", "src/a.ts", "./x.js"): ("file", "src/x.js"), ("r", "src/a.ts", "./dir"): ("file", "src/dir/index.ts"),
        ("r", "src/a.ts", "./y.d"): ("file", "src/y.d.ts"), ("r", "src/a.ts", "pkg/deep"): ("file", "named/src/index.ts"),
        ("r", "src/a.ts", "root/lib/z"): ("file", "lib/z.ts"), ("r", "src/a.ts", "./none"): ("unresolved", None),
        ("q", "src/a.ts", "./x"): ("unresolved", None),
        ("r", "main.py", "main"): ("file", "main.py"), ("r", "main.py", "src"): ("external", "src"), ("r", "main.py", "tool"): ("module", "tool"),
        ("r", "main.py", "."): ("unresolved", None), ("r", "main.py", ".index"): ("file", "index.py"),
        ("r", "java/app/Main.java", "app.Main"): ("file", "src/app/Main.java"), ("r", "java/app/Main.java", "java.app.Main"): ("file", "java/app/Main.java"),
        ("r", "src/main/java/src/T.java", "src.T"): ("file", "src/main/java/src/T.java"), ("r", "src/main/java/src/T.java", "other.T"): ("external", "other.T"),
        ("r", "src/lib.rs", "crate::index"): ("file", "src/index/mod.rs"), ("r", "src/lib.rs", "self::index"): ("file", "src/index/mod.rs"),
        ("r", "cmd/m.go", "root/cmd"): ("module", "cmd"), ("r", "cmd/m.go", "root/gone"): ("unresolved", None),
    }
    assert got == want
    # Equal rows are one, and each import travels once: one exchange of the imports and one of the files.
    assert imports.resolve_imports(extracted.unionByName(extracted), tree, modules, prefixes).count() == found.count() == len(want)
    extracted.write.parquet(f"{tmp_path}/imports")
    tree.write.parquet(f"{tmp_path}/tree")
    read = spark.read.parquet
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = imports.resolve_imports(read(f"{tmp_path}/imports"), read(f"{tmp_path}/tree"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2



def test_map_reads_few_texts(spark):
    """The files of the map's corpus are those of the view, and a reader of other paths leaves the documents' texts."""
    small = "/root/testdata/sf0.001"
    once = scans.corpus_once(spark, small, run_folder(spark))
    plain = scans.corpus(spark, small)
    assert sorted(once.columns) == sorted(plain.columns)
    assert once.select(plain.columns).exceptAll(plain).count() == plain.exceptAll(once.select(plain.columns)).count() == 0
    listing = once.where("admitted").drop("content")
    for signals in (ep.content_signals(once), manifests.manifests(once), ep.manifest_targets(once)):
        assert "doc_id:bigint,text" not in signals._jdf.queryExecution().executedPlan().toString()
    files = once.where("admitted AND content IS NOT NULL")
    assert rows(ep.entrypoint_signals(files, listing), "repo_id", "path", "kind") == rows(ep.entrypoint_signals(plain.where("admitted")), "repo_id", "path", "kind")
