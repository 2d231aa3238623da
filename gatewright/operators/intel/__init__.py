"""Code inventory: languages, manifests, modules, entrypoints, imports, graph, symbols."""
