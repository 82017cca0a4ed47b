"""A small shell: text in, rows out.  ``python -m quern.shell [name=folder ...]``.

list | use NAME | mount NAME FOLDER | unmount NAME | current | schema
query FIELD OP VALUE [and ...] [sort FIELD [asc|desc]] [limit N] [offset N] [--json|--ndjson]
explain query ... | fetchAll [--json|--ndjson] [limit N] | fetch ID | count
insert JSON | update ID JSON | delete ID | softDelete ID        (tables that are stores)
begin | commit | rollback
dump FOLDER | restore NAME FOLDER | verify FOLDER
policy add --preset NAME | policy enable | policy disable
"""

from __future__ import annotations

import json
import shlex
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import Catalog, get
from quern.operators import dml
from quern.plans import parse
from quern.plans.policy import PRESETS, Policies
from quern.query import Query
from quern.sources import io
from quern.sources.store import Store, Transaction


class Shell:
    """One command a call; ``run`` returns what to print."""

    def __init__(self, spark: SparkSession, key: str = "id", user: dict | None = None):
        self.spark, self.key, self.user = spark, key, user or {}
        self.catalog = Catalog(spark)
        self.stores: dict[str, Store] = {}
        self.open: Transaction | None = None
        self._base = 0

    def mount(self, name: str, folder: str) -> None:
        store = Store(self.spark, folder)
        if store.versions():
            self.stores[name] = store
            self.catalog.mount(name, store.read())
        else:
            self.catalog.mount(name, folder)

    @property
    def table(self) -> DataFrame:
        return self.open.table if self.open else self.catalog.tables[self.catalog.current]

    def _query(self, text: str) -> tuple[Query, str]:
        q = parse.parse(text)
        rules = self.catalog.policies.get(self.catalog.current)
        return q.query(self.table, rules.condition("select", self.user) if rules else None), q.output

    def _changed(self, step) -> str:
        if self.open:
            self.open.apply(step)
            return "staged"
        name = self.catalog.current
        if name not in self.stores:
            raise ValueError(f"{name} is read only")
        version = self.stores[name].change(step)
        self.catalog.mount(name, self.stores[name].read())
        return f"version {version}"

    def _row(self, text: str, like: DataFrame) -> DataFrame:
        given = json.loads(text)
        if not isinstance(given, dict):
            raise ValueError("a record is a JSON object")
        fields = [f for f in like.schema if f.name in given]
        return self.spark.range(1).select(F.from_json(F.lit(text), like.schema).alias("r")).select(*[F.col("r")[f.name].alias(f.name) for f in fields])

    def run(self, line: str) -> str:
        command, _, rest = line.strip().partition(" ")
        words = shlex.split(rest) if command not in ("insert", "update", "query", "explain") else rest.split(" ", 1)
        match command:
            case "" | "help":
                return __doc__
            case "list":
                return "\n".join(self.catalog.tables)
            case "current":
                return self.catalog.current or ""
            case "use":
                self.catalog.use(words[0])
                return words[0]
            case "mount":
                self.mount(*words)
                return words[0]
            case "unmount":
                self.stores.pop(words[0], None)
                self.catalog.unmount(words[0])
                return ""
            case "schema" | "inspect":
                return "\n".join(f"{c}\t{t}" for c, t in self.table.dtypes)
            case "count" | "status":
                return str(dml.visible(self.table).count())
            case "query":
                q, output = self._query(line)
                return parse.shown(q.to_df(), output)
            case "explain":
                return self._query(rest)[0].explain()
            case "fetchAll":
                output = "json" if "--json" in words else "ndjson" if "--ndjson" in words else "table"
                most = int(words[words.index("limit") + 1]) if "limit" in words else None
                return parse.shown(dml.visible(self.table), output, most)
            case "fetch":
                return parse.shown(get(dml.visible(self.table), parse.literal(words[0]), self.key), "ndjson")
            case "insert":
                return self._changed(lambda df: dml.insert(df, self._row(rest, df)))
            case "update":
                values = json.loads(words[1])
                return self._changed(lambda df: dml.update_fields(df, parse.literal(words[0]), values, self.key))
            case "delete":
                return self._changed(lambda df: dml.delete_many(df, F.col(self.key) == F.lit(parse.literal(words[0]))))
            case "softDelete":
                return self._changed(lambda df: dml.soft_delete(df, F.col(self.key) == F.lit(parse.literal(words[0]))))
            case "begin":
                store = self.stores[self.catalog.current]
                self._base, self.open = store.version(), Transaction(store.read())
                return "begun"
            case "commit":
                store, done = self.stores[self.catalog.current], self.open
                self.open = None
                version = store.write(done.table, self._base) if done.changed else store.version()
                self.catalog.mount(self.catalog.current, store.read())
                return f"version {version}"
            case "rollback":
                self.open = None
                return "rolled back"
            case "dump":
                io.write_dump(dml.visible(self.table), words[0], self.key, self.catalog.current)
                return words[0]
            case "restore":
                self.catalog.mount(words[0], io.restore_dump(self.spark, words[1]))
                return words[0]
            case "policy":
                # policy add --preset NAME | policy enable | policy disable
                rules = self.catalog.policies.setdefault(self.catalog.current, Policies())
                if words[0] == "add":
                    rules.add(*PRESETS[words[-1]]())
                else:
                    rules.enabled = {"enable": True, "disable": False}[words[0]]
                return f"{len(rules.rules)} policies, {'enabled' if rules.enabled else 'disabled'}"
            case "verify":
                return "ok" if io.verify_dump(self.spark, words[0]) else "damaged"
        raise ValueError(f"no such command: {command}")


def main(arguments: list[str]) -> None:
    from quern.session import session

    shell = Shell(session())
    for a in arguments:
        shell.mount(*a.split("=", 1))
    for line in sys.stdin:
        if line.strip() in ("quit", "exit"):
            break
        try:
            print(shell.run(line), flush=True)
        except Exception as e:
            print(f"error: {e}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
