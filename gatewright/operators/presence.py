"""Repository-level facts and the findings they imply.

Contents are judged beside the scan: every file becomes one bit set (`file_marks`).  All flags of a repository then
come from ONE aggregation over its narrow listing (`repo_facts`): booleans, an OR over the bit sets and one packed
integer, with a map-side combine, so a hot repository shrinks to one row per map task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatewright.functions.patterns import RULES as D
from gatewright.functions import paths as P
from gatewright.functions import text as X
from gatewright.operators.findings import SECURITY_ORD, draft, evidence, explode_drafts

# README facts packed into one integer so that min() picks the preferred file
# name and carries its features along:  priority | unread | length | url | sections
_PRIORITY, _UNREAD, _LENGTH, _URL = 10**16, 10**15, 10**3, 2**4


def _has(cond: Column) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False))


# What the contents of one file can say, by bit; the chains and networks that it names follow.
MARKS = [
    "pkg_read", "pkg_invalid", "pkg_scripted", "has_test_command", "has_run_command", "py_requirements", "py_project", "py_declares",
    "gitignore_env", "_runner", "has_contract_addresses", "any_address", "hack_demo_url", "hack_demo_video", "hack_architecture",
    "hack_submission", "hack_social", "hack_test_results", "mentions_hackathon", "_workflow_blank", "_workflow_idle", "_workflow_empty",
    *(f"_chain_{n}" for n in D.CHAIN_KEYWORDS), *(f"_net_{n}" for n in D.NETWORK_KEYWORDS),
]
assert len(MARKS) < 63


def _mark(name: str) -> int:
    return 1 << MARKS.index(name)


def _readme_features(content: Column) -> Column:
    body = X.strip_space(content)
    bits = [F.when(body.rlike(p), F.lit(2**i)).otherwise(0) for i, p in enumerate(D.README_SECTIONS.values())]
    return (
        X.utf16_length(body).cast("bigint") * _LENGTH
        + F.when(body.rlike(D.README_URL), F.lit(_URL)).otherwise(0)
        + sum(bits[1:], bits[0])
    )


def file_marks(files: DataFrame) -> DataFrame:
    """``files`` with read, marks and readme in place of their content.

    ``marks`` has one bit for each thing that a file can say about its repository, ``readme`` the packed features of a
    README.  Both come from the row alone, beside the scan, so no text is ever joined or shuffled for them; patterns
    run only where the path qualifies.
    """
    p, body, low = F.col("path"), F.col("content"), F.col("_low")
    pkg = F.when(p == "package.json", body)
    src = files.select(
        "*", F.when(pkg != "", F.try_parse_json(pkg)).alias("_pkg"), F.coalesce(pkg != "", F.lit(False)).alias("_pkg_read"),
        F.lower(body).alias("_low"), p.rlike(D.CHAIN_CONFIG_PATH).alias("_on_chain"), p.rlike(D.ADDRESS_PATH).alias("_on_address"),
        p.rlike(D.SUBMISSION_PATH).alias("_on_submit"), p.rlike(D.HYGIENE_WORKFLOW).alias("_workflow"),
    )
    src = src.withColumn("_scripts", F.try_variant_get("_pkg", "$.scripts", "map<string,string>"))
    src = src.withColumn("_urls", F.when(F.col("_on_submit") & body.contains("://"), _urls(body)))
    script = lambda name: F.coalesce(F.element_at("_scripts", F.lit(name)) != "", F.lit(False))
    bad = F.col("_pkg_read") & (F.col("_pkg").isNull() | F.is_variant_null("_pkg"))
    scripted = F.col("_pkg_read") & ~bad & (F.coalesce(F.size("_scripts"), F.lit(0)) > 0)
    on_chain, on_address, on_submit = F.col("_on_chain"), F.col("_on_address"), F.col("_on_submit")
    ignore_line = lambda l: X.strip_space(l)
    ignores_env = F.exists(X.lines_of(body), lambda l: ignore_line(l).startswith(".env") | ignore_line(l).rlike(r"\A\*\.env/*\z"))
    workflow = F.col("_workflow")
    blank = X.strip_space(body) == ""
    says = lambda pattern, literals: X.says(body, low, pattern, literals)
    address = body.contains("0x") & body.rlike(D.ADDRESS)
    said = {
        "pkg_read": F.col("_pkg_read"),
        "pkg_invalid": bad,
        "pkg_scripted": scripted,
        "has_test_command": scripted & (script("test") | script("test:unit")),
        "has_run_command": scripted & (script("dev") | script("start")),
        "py_requirements": body != "",
        "py_project": body != "",
        "py_declares": (body != "") & body.rlike(D.PYPROJECT_DEPS),
        "gitignore_env": ignores_env,
        "_runner": F.when(p == "package.json", body.rlike(D.TEST_RUNNER_DEPENDENCY)).otherwise(body.contains("pytest")),
        "has_contract_addresses": address,
        "any_address": address,
        "hack_demo_url": F.exists("_urls", lambda u: u.rlike(D.DEMO_HOST)),
        "hack_demo_video": F.exists("_urls", lambda u: u.rlike(D.VIDEO_HOST)),
        "hack_architecture": body.contains("#") & says(D.ARCHITECTURE_HEADING, D.ARCHITECTURE_LITERALS),
        "hack_submission": says(D.SUBMISSION_TEXT, D.SUBMISSION_LITERALS),
        "hack_social": says(D.SOCIAL_TEXT, D.SOCIAL_LITERALS),
        "hack_test_results": says(D.TEST_RESULT_TEXT, D.TEST_RESULT_LITERALS),
        "mentions_hackathon": says(D.HACKATHON_TEXT, D.HACKATHON_LITERALS),
        "_workflow_blank": blank,
        "_workflow_idle": ~blank & ~body.rlike(r"(?m)^on\s*:"),
        "_workflow_empty": ~blank & ~body.rlike(r"(?m)^jobs\s*:"),
        **{f"_chain_{n}": says(r, D.CHAIN_LITERALS[n]) for n, r in D.CHAIN_KEYWORDS.items()},
        **{f"_net_{n}": says(r, D.NETWORK_LITERALS[n]) for n, r in D.NETWORK_KEYWORDS.items()},
    }

    none = F.lit(0).cast("bigint")

    def bit(name: str) -> Column:
        return F.when(said[name], F.lit(_mark(name)).cast("bigint")).otherwise(none)

    # A path is asked once what it is; only then are the patterns of its kind tried.
    kinds = [
        (p == "package.json", ["pkg_read", "pkg_invalid", "pkg_scripted", "has_test_command", "has_run_command", "_runner"]),
        (p == "pyproject.toml", ["py_project", "py_declares", "_runner"]),
        (p == "requirements.txt", ["py_requirements"]),
        (F.lower(p) == ".gitignore", ["gitignore_env"]),
        (on_address, ["has_contract_addresses"]),
        (on_chain | on_address | on_submit, ["any_address"]),
        (on_submit, [n for n in MARKS if n.startswith(("hack_", "_net_"))]),
        (on_chain, [n for n in MARKS if n.startswith("_chain_")]),
        (workflow, [n for n in MARKS if n.startswith("_workflow_")]),
    ]
    assert {n for _, names in kinds for n in names} == set(MARKS) - {"mentions_hackathon"}
    told = [F.when(kind, reduce(Column.__add__, map(bit, names))).otherwise(none) for kind, names in kinds]
    bits = reduce(Column.__add__, told, bit("mentions_hackathon"))
    readme = F.when(P.among(F.regexp_replace(p, r"^\./", ""), D.README_NAMES), _readme_features(body))
    kept = [c for c in files.columns if c != "content"]
    return src.select(*kept, body.isNotNull().alias("read"), F.when(body.isNotNull(), bits).alias("marks"), readme.alias("readme"))


def path_flags(lockfiles_from: str = "admitted") -> list[Column]:
    """Aggregates of a listing (path, admitted) that ask for no contents.

    Document, screenshot and licence flags read the whole tree, the others admitted files only.  With
    ``lockfiles_from="tree"`` lockfiles classified as binary count as well.
    """
    p, entry = F.col("path"), F.col("admitted")
    clean = F.regexp_replace(p, r"^\./", "")
    own = entry & ~P.is_sample_material(p)
    lock_scope = F.lit(True) if lockfiles_from == "tree" else entry
    flags = {flag: P.among(clean, names) for _, flag, _, _, names in D.REQUIRED_DOCS}
    flags |= {
        "has_screenshots": p.rlike(D.SCREENSHOT),
        "hack_license": p.rlike(D.HACK_LICENSE_PATH),
        "has_lockfile": lock_scope & P.among(clean, D.LOCKFILES),
        "has_ci": entry & p.rlike(D.CI_WORKFLOW),
        "has_docker": entry & p.rlike(D.DOCKER_PATH),
        "has_gitignore": entry & (F.lower(p) == ".gitignore"),
        "has_test_files": entry & p.rlike(D.HYGIENE_TEST_PATH),
        "_pytest": entry & p.rlike(D.PYTEST_PATH),
        "has_contracts": own & p.rlike(D.CONTRACT_DIR) & p.rlike(D.CONTRACT_FILE),
        "has_deploy_scripts": own & p.rlike(D.DEPLOY_PATH),
        "has_abi": own & p.rlike(D.ABI_JSON) & p.rlike(D.ABI_PATH),
        "has_contract_tests": own & p.rlike(D.CONTRACT_TEST),
        "has_audit_note": own & p.rlike(D.AUDIT_NOTE),
    }
    return [_has(cond).alias(flag) for flag, cond in flags.items()]


def path_facts(listing: DataFrame, lockfiles_from: str = "admitted") -> DataFrame:
    """The flags of a repository that its listing (repo_id, path, admitted) answers; no file is read."""
    return listing.groupBy("repo_id").agg(*path_flags(lockfiles_from)).drop("_pytest")


def repo_facts(corpus: DataFrame, lockfiles_from: str = "admitted") -> DataFrame:
    """One row of flags per repository.

    ``corpus(repo_id, path, admitted)`` with the columns of `file_marks`, or with ``content``, which is marked first.
    All flags come from one hash aggregation of booleans, of one OR over the marks and of one packed integer, so a hot
    repository shrinks to one row per map task.
    """
    if "marks" not in corpus.columns:
        corpus = file_marks(corpus)
    entry = F.col("admitted")
    clean = F.regexp_replace("path", r"^\./", "")
    names = F.array(*[F.lit(n) for n in D.README_NAMES])
    features = F.coalesce(F.when(entry, F.col("readme")), F.lit(_UNREAD).cast("bigint"))
    code = F.when(P.among(clean, D.README_NAMES), (F.array_position(names, clean) - 1) * F.lit(_PRIORITY) + features)
    wide = corpus.groupBy("repo_id").agg(
        *path_flags(lockfiles_from),
        F.min(code).alias("_readme"),
        F.coalesce(F.bit_or(F.when(entry, F.col("marks"))), F.lit(0)).alias("_marks"),
    )
    said = lambda name: F.col("_marks").bitwiseAND(F.lit(_mark(name)).cast("bigint")) != 0

    def names_of(columns: list[tuple[str, Column]]) -> Column:
        return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in columns])))

    chains = names_of([(n, said(f"_chain_{n}")) for n in D.CHAIN_KEYWORDS])
    nets = names_of([(n, said(f"_net_{n}")) for n in D.NETWORK_KEYWORDS])
    code = F.col("_readme")
    features = F.pmod(code, F.lit(_PRIORITY))
    is_read = code.isNotNull() & (features < _UNREAD)
    bits = F.pmod(features, F.lit(_LENGTH)).cast("int")
    return (
        wide.withColumns({name: said(name) for name in MARKS if not name.startswith("_")})
        .withColumn("has_test_runner", said("_runner") | F.col("_pytest"))
        .withColumn("chains", chains)
        .withColumn("networks", F.array_sort(F.array_union("chains", nets)))
        .withColumn("hack_network", F.size("networks") > 0)
        .withColumn("readme_file", F.get(names, F.floor(code / _PRIORITY).cast("int")))
        .withColumn("readme_length", F.when(is_read, F.floor(features / _LENGTH).cast("int")))
        .withColumn("has_demo_url", F.coalesce(is_read & (bits.bitwiseAND(F.lit(_URL)) > 0), F.lit(False)))
        .withColumn("readme_sections", F.when(is_read, bits.bitwiseAND(F.lit(_URL - 1))))
        .drop("_readme", "_marks", "_pytest")
    )


def _urls(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(D.URL), F.lit(0))


# --- findings from facts --------------------------------------------------------------
def missing_docs(facts: DataFrame) -> DataFrame:
    """Findings for required documents that the listing lacks; `path_facts` is enough."""
    out = []
    for i, (fid, flag, sev, title, names) in enumerate(D.REQUIRED_DOCS):
        proof = F.array(evidence(names[0], None, "no such file is listed"))
        out.append(
            (
                ~F.col(flag),
                draft("doc", i, fid, "documentation", sev, title, proof,
                      f"Put a {names[0]} at the top of the tree.",
                      [f"{names[0]} lies at the top of the tree."]),
            )
        )
    return explode_drafts(facts, out)


def doc_findings(facts: DataFrame) -> DataFrame:
    return missing_docs(facts).unionByName(readme_findings(facts))


def readme_findings(facts: DataFrame) -> DataFrame:
    out = []
    length = F.col("readme_length")
    at_readme = lambda reason: F.array(evidence(F.col("readme_file"), 1, reason))
    out.append(
        (
            length < D.README_MIN_CHARS,
            draft("doc", 10, "doc-readme-short", "documentation", "medium",
                  "The README says too little to start from",
                  at_readme(F.concat(length, F.lit(" characters")))),
        )
    )
    for i, name in enumerate(D.README_SECTIONS):
        missing = F.col("readme_sections").bitwiseAND(F.lit(2**i)) == 0
        out.append(
            (
                (length >= D.README_MIN_CHARS) & missing,
                draft("doc", 11 + i, f"doc-readme-section-{name}", "documentation", "low",
                      f"The README has no part on {name}",
                      at_readme("no heading or link fits")),
            )
        )
    return explode_drafts(facts, out)


def _fact(section: str, ord_: int, fid: str) -> Column:
    category, sev, title, file, reason = D.FACT_FINDINGS[fid]
    return draft(section, ord_, fid, category, sev, title, F.array(evidence(file, None, reason)))


def repro_findings(facts: DataFrame) -> DataFrame:
    c = F.col
    usable = c("pkg_read") & ~c("pkg_invalid")
    rules = [
        ("repro-no-lockfile", ~c("has_lockfile")),
        ("repro-no-ci", ~c("has_ci")),
        ("repro-no-scripts", usable & ~c("pkg_scripted")),
        ("repro-no-test-script", c("pkg_scripted") & ~c("has_test_command")),
        ("repro-no-run-script", c("pkg_scripted") & ~c("has_run_command")),
        ("repro-pkg-invalid", c("pkg_invalid")),
        ("repro-py-no-requirements", c("py_project") & ~c("py_requirements") & ~c("py_declares")),
        ("repro-no-docker", ~c("has_docker")),
    ]
    return explode_drafts(facts, [(cond, _fact("repro", i, fid)) for i, (fid, cond) in enumerate(rules)])


def web3_findings(facts: DataFrame) -> DataFrame:
    c = F.col
    rules = [
        ("web3-no-deploy-script", ~c("has_deploy_scripts")),
        ("web3-no-contract-tests", ~c("has_contract_tests")),
        ("web3-no-chain-config", F.size("chains") == 0),
        ("web3-no-audit-note", ~c("has_audit_note")),
    ]
    pairs = [(c("has_contracts") & cond, _fact("web3", i, fid)) for i, (fid, cond) in enumerate(rules)]
    return explode_drafts(facts, pairs)


def hackathon_findings(facts: DataFrame) -> DataFrame:
    """Reads the web3 flags: networks and addresses found there count here too."""
    c = F.col
    rules = [
        ("hack-no-demo", ~c("hack_demo_url")),
        ("hack-no-video", ~c("hack_demo_video")),
        ("hack-no-architecture", ~c("hack_architecture")),
        ("hack-no-screenshots", ~c("has_screenshots")),
        ("hack-no-social", ~c("hack_social")),
        ("hack-no-license", ~c("hack_license")),
        ("hack-no-chain", ~c("hack_network") & ~c("any_address")),
    ]
    return explode_drafts(facts, [(cond, _fact("hack", i, fid)) for i, (fid, cond) in enumerate(rules)])


def hygiene_findings(corpus: DataFrame, facts: DataFrame) -> DataFrame:
    """Environment files, ignore rules, workflows that cannot run, tests nothing runs.

    ``corpus`` is marked (`file_marks`); a committed environment file is one short row of its repository's list.
    """
    if "marks" not in corpus.columns:
        corpus = file_marks(corpus)
    p = F.col("path")
    is_env = p.rlike(D.ENV_FILE) & ~p.rlike(D.ENV_TEMPLATE)
    is_test = p.rlike(D.HYGIENE_TEST_PATH)
    at = F.struct("list_pos", "path")
    lists = (
        corpus.where(F.col("admitted") & (is_env | is_test))
        .groupBy("repo_id")
        .agg(
            F.array_sort(F.collect_list(F.when(is_env, at))).alias("env_files"),
            F.min(F.when(is_test, at)).alias("first_test"),
        )
    )
    rows = facts.join(lists, "repo_id", "left")
    committed = F.coalesce(F.size("env_files") > 0, F.lit(False))
    env_proof = F.transform(
        F.col("env_files"),
        lambda e: evidence(e["path"], None, "the listing has it", "file_tree"),
    )
    ignore_proof = F.array(
        evidence(
            ".gitignore",
            None,
            F.when(F.col("has_gitignore"), F.lit("it names no .env")).otherwise("there is no such file"),
            F.when(F.col("has_gitignore"), F.lit("text_match")).otherwise("file_tree"),
        )
    )
    first_env = F.get("env_files", F.lit(0))["path"]
    drafts = [
        (
            committed,
            draft("security", SECURITY_ORD["hygiene"], F.concat(F.lit("env-committed-"), X.slugify(first_env)), "security",
                  "critical", "Environment settings lie in the tree", env_proof),
        ),
        (
            ~committed & ~F.col("gitignore_env"),
            draft("security", SECURITY_ORD["hygiene"] + 1, "env-not-ignored", "security", "medium", "Nothing keeps .env out of commits",
                  ignore_proof),
        ),
        (
            ~F.col("has_gitignore"),
            draft("hygiene", 0, "repo-no-gitignore", "reproducibility", "low", "The tree has no .gitignore",
                  F.array(evidence(".gitignore", None, "none at the top of the tree", "file_tree"))),
        ),
        (
            F.col("has_test_files") & ~F.col("has_test_runner"),
            draft("hygiene", 10**18, "test-no-runner", "reproducibility", "medium",
                  "Nothing is set up to run the tests",
                  F.array(evidence(F.col("first_test")["path"], None,
                                   "tests lie here, and no manifest names a runner",
                                   "dependency_manifest"))),
        ),
    ]
    return explode_drafts(rows, drafts).unionByName(workflow_findings(corpus))


def workflow_findings(corpus: DataFrame) -> DataFrame:
    """Workflows lacking a trigger or jobs, from their marks.  Unread files are not judged."""
    said = lambda name: F.col("marks").bitwiseAND(F.lit(_mark(name)).cast("bigint")) != 0
    problems = F.array_compact(
        F.array(
            F.when(said("_workflow_blank"), F.lit("the file is empty")),
            F.when(said("_workflow_idle"), F.lit("no `on:` trigger is declared")),
            F.when(said("_workflow_empty"), F.lit("no `jobs:` block is declared")),
        )
    )
    rows = (
        corpus.where(F.col("admitted") & F.col("marks").isNotNull())
        .withColumn("problems", problems)
        .where(F.size("problems") > 0)
    )
    finding = draft(
        "hygiene", F.col("list_pos") + 1, F.concat(F.lit("ci-workflow-invalid-"), X.slugify(F.col("path"))),
        "reproducibility", "high", "A CI workflow would not run",
        F.array(evidence(F.col("path"), None, F.array_join("problems", "; "), "workflow")),
    )
    return explode_drafts(rows, [(F.lit(True), finding)])


def contract_addresses(corpus: DataFrame) -> DataFrame:
    """Distinct (repo_id, address) over configuration, address and submission files."""
    p = F.col("path")
    where = p.rlike(D.CHAIN_CONFIG_PATH) | p.rlike(D.ADDRESS_PATH) | p.rlike(D.SUBMISSION_PATH)
    rows = corpus.where(F.col("admitted") & where & F.col("content").rlike(D.ADDRESS))
    found = F.regexp_extract_all("content", F.lit(D.ADDRESS), F.lit(0))
    return rows.select("repo_id", F.explode(found).alias("address")).distinct()


def submission_urls(corpus: DataFrame) -> DataFrame:
    """URLs of submission documents, marked as demo or video."""
    rows = corpus.where(F.col("admitted") & F.col("path").rlike(D.SUBMISSION_PATH))
    urls = rows.select("repo_id", "path", F.explode(_urls(F.col("content"))).alias("url"))
    return urls.select(
        "*", F.col("url").rlike(D.DEMO_HOST).alias("is_demo"), F.col("url").rlike(D.VIDEO_HOST).alias("is_video")
    ).where(F.col("is_demo") | F.col("is_video"))


# --- stack and free check ------------------------------------------------------------------
STACK_EVIDENCE = "struct<key:string,label:string,confidence:double,file:string,line:int,reason:string>"


def _signal(key: str, label: str, confidence: float, file, line, reason: str) -> Column:
    col = file if isinstance(file, Column) else F.lit(file)
    return F.struct(
        F.lit(key).alias("key"),
        F.lit(label).alias("label"),
        F.lit(confidence).alias("confidence"),
        col.alias("file"),
        F.lit(line).cast("int").alias("line"),
        F.lit(reason).alias("reason"),
    )


def stack_paths(listing: DataFrame) -> DataFrame:
    """Stack signals of admitted paths: patterns, languages, host configurations."""
    p = F.col("path")
    own = ~P.is_sample_material(p)
    rows = listing.where(F.col("admitted")).withColumn("_lang", P.language_of(p))
    signals = [F.when(own & p.rlike(rx), _signal(k, l, c, p, None, f"the path says {l}")) for k, l, rx, c in D.STACK_PATHS]
    signals += [
        F.when(own & F.col("_lang").isin(*langs), _signal(k, l, c, p, None, f"{l} source file"))
        for k, l, langs, c in D.STACK_LANGUAGES
    ]
    signals += [
        F.when(own & P.basename(p).isin(*names), _signal(k, l, c, file, None, f"{file} present"))
        for k, l, names, file, c in D.STACK_HOSTS
    ]
    return rows.select("repo_id", F.explode(F.array_compact(F.array(*signals))).alias("s")).select("repo_id", "s.*")


def stack_contents(files: DataFrame) -> DataFrame:
    """(repo_id, path, signal): stack signals of the few manifests whose contents tell, one scan and nothing joined."""
    p, body = F.col("path"), F.col("content")
    rows = files.where(p.isin("package.json", *{file for _, _, file, _ in D.STACK_MANIFESTS}) & (body != ""))
    rows = rows.withColumn("_pkg", F.when(p == "package.json", F.try_parse_json(body)))
    deps = F.array_union(
        *[
            F.coalesce(
                F.map_keys(
                    F.map_filter(
                        F.try_variant_get("_pkg", f"$.{field}", "map<string,string>"), lambda k, v: v != ""
                    )
                ),
                F.array().cast("array<string>"),
            )
            for field in ("dependencies", "devDependencies")
        ]
    )
    rows = rows.withColumn("_deps", deps)
    signals = [
        F.when(F.arrays_overlap("_deps", F.array(*[F.lit(n) for n in names])), _signal(k, l, c, "package.json", None, f"{l} is required"))
        for k, l, names, c in D.STACK_DEPENDENCIES
    ]
    signals += [F.when(p == file, _signal(k, l, c, file, 1, f"{file} present")) for k, l, file, c in D.STACK_MANIFESTS]
    return rows.select("repo_id", "path", F.explode(F.array_compact(F.array(*signals))).alias("s"))


def stack_evidence(listing: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """One row per stack signal of a listing (repo_id, path, admitted) and its files (repo_id, path, content).

    Without ``files`` the listing is a corpus and holds the contents itself.  Signals of contents, not the contents,
    meet the listing.
    """
    contents = stack_contents(listing if files is None else files)
    admitted = listing.where("admitted").select("repo_id", "path")
    told = contents.join(admitted, ["repo_id", "path"], "left_semi").select("repo_id", "s.*")
    return stack_paths(listing).unionByName(told)


def detect_stack(listing: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Per (repo, key): label, best confidence, number of signals; kept at 0.5 and above."""
    return (
        stack_evidence(listing, files)
        .groupBy("repo_id", "key")
        .agg(
            F.min("label").alias("label"),
            F.max("confidence").alias("confidence"),
            F.count(F.lit(1)).alias("signals"),
        )
        .where(F.col("confidence") >= D.STACK_MIN_CONFIDENCE)
    )


def stack_buckets(stack: DataFrame) -> DataFrame:
    """languages / frameworks / runtimes per repository, sorted."""
    spark = stack.sparkSession
    dim = F.broadcast(spark.createDataFrame(D.STACK_BUCKETS, "key string, bucket string, name string"))
    hits = stack.select("repo_id", "key").join(dim, "key")
    pick = lambda b: F.array_sort(F.collect_set(F.when(F.col("bucket") == b, F.col("name"))))
    return hits.groupBy("repo_id").agg(*[pick(b).alias(b) for b in ("languages", "frameworks", "runtimes")])


def frameworks(stack: DataFrame) -> DataFrame:
    """Framework labels, best confidence first (at most the seven known keys)."""
    rows = stack.where(F.col("key").isin(*D.FRAMEWORK_KEYS))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "label")))
    return rows.groupBy("repo_id").agg(F.transform(ordered, lambda s: s["label"]).alias("frameworks"))


def free_check(tree: DataFrame) -> DataFrame:
    """Five checks on the tree alone; the shortest matching path is the evidence."""
    p = F.col("path")
    base = P.basename(p)
    checks = [
        ("has-readme", P.among(base, D.README_NAMES), True, "no README is listed"),
        ("has-license", P.among(base, D.LICENSE_NAMES), True, "no licence is listed"),
        ("has-env-example", P.among(base, D.ENV_EXAMPLE_NAMES), True, "no settings template is listed"),
        ("has-lockfile", p.rlike(D.FREE_LOCKFILE), False, "no lock file is listed"),
        ("has-ci", p.rlike(D.FREE_CI), False, "no CI set-up is listed"),
    ]
    short = F.struct(F.length(p).alias("n"), F.col("list_pos"), p.alias("path"))
    first = F.struct(F.lit(0).alias("n"), F.col("list_pos"), p.alias("path"))
    best = tree.groupBy("repo_id").agg(
        *[F.min(F.when(cond, short if by_len else first)).alias(cid) for cid, cond, by_len, _ in checks]
    )
    items = [
        F.struct(
            F.lit(cid).alias("id"),
            F.col(cid).isNotNull().alias("passed"),
            F.coalesce(F.concat(F.col(cid)["path"], F.lit(" found")), F.lit(fallback)).alias("evidence"),
        )
        for cid, _, _, fallback in checks
    ]
    passed = sum([F.col(c[0]).isNotNull().cast("int") for c in checks[1:]], F.col(checks[0][0]).isNotNull().cast("int"))
    return best.select(
        "repo_id",
        F.array(*items).alias("checks"),
        passed.alias("passed"),
        F.lit(len(checks)).alias("total"),
        F.floor(passed * 100 / len(checks) + 0.5).cast("int").alias("score"),
    )
