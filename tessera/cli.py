"""Command line of a store: python -m tessera.cli FOLDER COMMAND ..., or a prompt without a command."""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from tessera.api import Store
from tessera.errors import EngineError
from tessera.functions.text import preview, split_arguments
from tessera.operators.kv import scan
from tessera.sources.text import parse_tokens

HELP = """put KEY VALUE...   get KEY   delete KEY   scan START END [LIMIT]   bput KEY:VALUE...   bget KEY...
vput KEY X,Y,...   vget KEY   vsearch X,Y,... [K]   stats   info   clear   help   quit"""


def _vector(text: str) -> list[float]:
    try:
        return [float(x) for x in text.split(",")]
    except ValueError:
        raise EngineError("INVALID_ARGUMENT", f"{text!r} is not a vector") from None


def run(store: Store, words: list[str]) -> list[str]:
    """The lines that a command answers."""
    name, args = (words[0].lower(), words[1:]) if words else ("help", [])
    least = {"put": 2, "get": 1, "delete": 1, "scan": 2, "bput": 1, "bget": 1, "vput": 2, "vget": 1, "vsearch": 1}
    if len(args) < least.get(name, 0):
        raise EngineError("INVALID_ARGUMENT", f"{name} needs {least[name]} arguments")
    if name == "put":
        store.put(args[0], " ".join(args[1:]))
    elif name == "get":
        found = store.get(args[0])
        return ["(not found)" if found is None else found]
    elif name == "delete":
        store.delete(args[0])
    elif name == "scan":
        rows = scan(store.entries(), args[0], args[1], limit=int(args[2]) if len(args) > 2 else 0)
        return [f"{r.key} = {r.value}" for r in rows.select("key", preview(F.col("value"), 50).alias("value")).toLocalIterator()]
    elif name == "bput":
        tokens = store.spark.createDataFrame([(t,) for t in args], "token string")
        store.batch_put({r.key: r.value for r in parse_tokens(tokens).collect()})
    elif name == "bget":
        return [f"{k} = {'(not found)' if v is None else v}" for k, v in store.batch_get(args).items()]
    elif name == "vput":
        store.put_vector(args[0], _vector(args[1]))
    elif name == "vget":
        found = store.get_vector(args[0])
        return ["(not found)" if found is None else ",".join(f"{x:g}" for x in found.to_list())]
    elif name == "vsearch":
        hits = store.search_similar(_vector(args[0]), int(args[1]) if len(args) > 1 else 5)
        return [f"{r.key} {r.distance:g}" for r in hits.collect()]
    elif name in ("stats", "info"):
        return [f"{k}: {v}" for k, v in store.stats().items()]
    elif name == "clear":
        store.clear()
    elif name == "help":
        return HELP.splitlines()
    else:
        raise EngineError("INVALID_ARGUMENT", f"unknown command {name}")
    return ["OK"]


def main(argv: list[str]) -> int:
    from tessera.session import session

    if not argv:
        print(__doc__, HELP, sep="\n")
        return 1
    with Store(session(), argv[0]) as store:
        lines = [argv[1:]] if argv[1:] else map(split_arguments, sys.stdin)
        for words in lines:
            if words and words[0].lower() in ("quit", "exit"):
                break
            try:
                print(*run(store, words), sep="\n")
            except EngineError as e:
                print(e)
                if argv[1:]:
                    return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
