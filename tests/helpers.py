"""Tiny corpora as literal rows."""

from gatewright.sources.corpus import FILES_SCHEMA, TREE_SCHEMA


def corpus(spark, repos: dict[str, dict[str, str | None]]):
    """{repo: {path: content or None}} -> (tree, files); None means listed but not read."""
    tree, files = [], []
    for repo, entries in repos.items():
        for pos, (path, content) in enumerate(entries.items()):
            tree.append((repo, path, len((content or "").encode()), pos))
            if content is not None:
                files.append((repo, path, content))
    return spark.createDataFrame(tree, TREE_SCHEMA), spark.createDataFrame(files, FILES_SCHEMA)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())
