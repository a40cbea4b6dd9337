"""Scripts over a revision log: one run on the driver, or one plan for a table of parameters."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Typed, compile_node, text as column_text
from ..functions.language import CONTEXT_FUNCTIONS, FUNCTIONS, ScriptError, Value, binary, parse, text
from ..operators import folds, reads, scans


class Outcome(NamedTuple):
    """status: Get, Set, NotSet, Deleted, DoesNotExist, Aborted or Errored; writes: what is to be applied."""

    status: str
    value: object
    revision: int
    writes: list


class _Stop(Exception):
    def __init__(self, value) -> None:
        self.value = value


class Session:
    """Runs scripts against a log; accepted writes stay in the session and are seen by later scripts."""

    def __init__(self, log: DataFrame | None, now_l: int, tiers: dict[str, DataFrame] | None = None) -> None:
        self.logs = tiers or ({"P": log} if log is not None else {})
        self.now_l, self.staged, self.seq = now_l, {}, 0

    def _entry(self, tier: str, key: str) -> dict:
        if (tier, key) not in self.staged:
            e = folds.new_entry()
            if tier in self.logs:
                row = reads.newest(self.logs[tier].where(F.col("key") == key)).first()
                if row:
                    e = {"revision": row["revision"], "value": row["value"], "expires": row["expires_l"], "state": row["state"], "ts": row["ts_l"]}
            self.staged[tier, key] = e
        return self.staged[tier, key]

    def run(self, script: str, params: dict[str, str] | None = None) -> Outcome:
        before = {k: dict(v) for k, v in self.staged.items()}
        try:
            block = parse(script)
            run = _Run(self, params or {})
            body, commits = block, True
            if len(block) == 1 and block[0][0] == "begin":
                options = {k: run.eval(v).v if v[0] != "var" else v[1] for k, v in block[0][1].items()}
                commits = str(options.get("autoCommit", "false")).lower() == "true"
                run.snapshot = options.get("snapshot")
                body = block[0][2]
            run.committed = commits
            try:
                run.block(body)
            except _Stop as s:
                run.last = ("Get", s.value.v, s.value.revision)
            if not run.committed:
                self.staged = before
                return Outcome("Aborted", None, -1, [])
            return Outcome(*run.last, run.writes)
        except ScriptError as e:
            self.staged = before
            return Outcome("Errored", str(e), -1, [])


class _Run:
    def __init__(self, session: Session, params: dict[str, str]) -> None:
        self.s, self.params, self.vars = session, params, {}
        self.last, self.modified, self.writes = ("Get", None, -1), None, []
        self.committed, self.done, self.snapshot = True, False, None

    def eval(self, n: tuple) -> Value:
        if n[0] == "lit":
            return Value(n[1])
        if n[0] == "param":
            if n[1] not in self.params:
                raise ScriptError(f"{n[1]} is not given")
            return Value(str(self.params[n[1]]))
        if n[0] == "var":
            if n[1] not in self.vars:
                raise ScriptError(f"{n[1]} is not bound")
            return self.vars[n[1]]
        if n[0] == "not set":
            return Value(self.modified != "Set")
        if n[0] == "not found":
            return Value(self.last[0] != "Get")
        if n[0] == "not":
            v = self.eval(n[1]).v
            if not isinstance(v, bool | int | float):
                raise ScriptError("not of this value")
            return Value(not v if isinstance(v, bool) else v != 0)
        if n[0] == "op":
            a, b = self.eval(n[2]), self.eval(n[3])
            return Value(binary(n[1], a.v, b.v))
        if n[0] == "index":
            a, i = self.eval(n[1]).v, self.eval(n[2]).v
            if not isinstance(a, list) or type(i) is not int or not 0 <= i < len(a):
                raise ScriptError("index out of bounds")
            return a[i] if isinstance(a[i], Value) else Value(a[i])
        _, name, args = n
        args = [self.eval(a) for a in args]
        if name in CONTEXT_FUNCTIONS:
            if name == "current_time":
                return Value(self.s.now_l)
            if len(args) != 1:
                raise ScriptError(f"{name} takes one argument")
            return Value(args[0].expires if name == "expires" else args[0].revision)
        if name not in FUNCTIONS:
            raise ScriptError(f"no function {name}")
        n_args, f = FUNCTIONS[name]
        if len(args) != n_args:
            raise ScriptError(f"{name} takes {n_args} arguments")
        return Value(f(*[a.v for a in args]))

    def key(self, n: tuple) -> str:
        return self.eval(n).v

    def block(self, statements: tuple) -> None:
        for s in statements:
            if self.done:
                return
            self.statement(s)

    def statement(self, s: tuple) -> None:
        op = s[0]
        if op == "let":
            self.vars[s[1]] = self.eval(s[2])
        elif op == "if":
            test = self.eval(s[1]).v
            self.block(s[2] if test is True else s[3])
        elif op == "for":
            items = self.eval(s[2]).v
            if not isinstance(items, list):
                raise ScriptError("for takes an array")
            for x in items:
                self.vars[s[1]] = x if isinstance(x, Value) else Value(x)
                self.block(s[3])
                if self.done:
                    return
        elif op == "return":
            raise _Stop(self.eval(s[1]) if s[1] else Value(None))
        elif op == "throw":
            raise ScriptError(text(self.eval(s[1]).v))
        elif op == "sleep":
            if not 0 <= s[1] <= 300_000:
                raise ScriptError("sleep is 0 to 300000 ms")
        elif op == "commit":
            self.committed = self.done = True
        elif op == "rollback":
            self.committed, self.done = False, True
        elif op in ("set", "delete", "extend"):
            self.write(s)
        elif op in ("get", "exists"):
            self.read(s)
        elif op in ("bucket", "prefix"):
            self.scan(s)
        else:
            raise ScriptError(f"{op} cannot stand here")

    def write(self, s: tuple) -> None:
        if self.snapshot is not None:
            raise ScriptError("a snapshot cannot be written to")
        op, tier, key = s[0], s[1], self.key(s[2])
        m = {"seq": self.s.seq, "op": op.upper(), "key": key, "value": None, "nx": False, "xx": False, "cmp_value": None, "cmp_rev": None, "norev": False, "ttl_ms": 0, "ts_l": self.s.now_l}
        if op == "set":
            m["value"] = text(self.eval(s[3]).v)
            for flag, arg in s[4]:
                v = self.eval(arg).v if arg else True
                if flag in ("ex", "cmprev") and type(v) is not int:
                    raise ScriptError(f"{flag} takes an integer")
                m[{"ex": "ttl_ms", "cmp": "cmp_value", "cmprev": "cmp_rev"}.get(flag, flag)] = text(v) if flag == "cmp" else v
        elif op == "extend":
            m["ttl_ms"] = s[3]
        self.s.seq += 1
        _, _, status, revision, *_ = folds.mutate(self.s._entry(tier, key), m)
        self.modified, self.last = status, (status, None, revision)
        if status in ("Set", "Deleted", "Extended"):
            self.writes.append((tier, m))

    def _seen(self, tier: str, key: str, revision, as_of):
        if revision is None and as_of is None:
            e = self.s._entry(tier, key)
            ok = e["state"] == "Set" and (e["expires"] is None or e["expires"] >= self.s.now_l)
            return (e["value"], e["revision"], e["expires"] or 0) if ok else None
        if tier not in self.s.logs:
            return None
        log = self.s.logs[tier].where(F.col("key") == key)
        row = (reads.by_revision(log, revision) if revision is not None else reads.as_of(log, as_of, self.s.now_l)).first()
        return (row["value"], row["revision"], row["expires_l"] or 0) if row else None

    def _time(self, node):
        at = self.eval(node).v if node else self.snapshot
        if at is not None and (type(at) is not int or at <= 0):
            raise ScriptError("as of takes a positive integer")
        return at

    def read(self, s: tuple) -> None:
        op, tier, key, revision, as_of, into = s
        found = self._seen(tier, self.key(key), revision, self._time(as_of) if revision is None else None)
        if op == "exists":
            self.last = ("Exists", True, found[1]) if found else ("DoesNotExist", False, -1)
            value = Value(True, found[1], found[2]) if found else Value(None)
        else:
            self.last = ("Get", *found[:2]) if found else ("DoesNotExist", None, -1)
            value = Value(*found) if found else Value(None)
        if into:
            self.vars[into] = value

    def scan(self, s: tuple) -> None:
        op, tier, key, _, as_of, into = s
        prefix, at = self.key(key), self._time(as_of)
        rows = {}
        if tier in self.s.logs:
            log = self.s.logs[tier]
            found = scans.by_bucket(log, prefix, as_of_l=at, now_l=self.s.now_l) if op == "bucket" else scans.by_prefix([log if at is None else log.where(F.col("ts_l") <= at)], prefix, now_l=self.s.now_l).orderBy("key").limit(scans.SCAN_LIMIT)
            rows = {r["key"]: Value(r["value"], r["revision"], r["expires_l"] or 0) for r in found.collect()}
        if at is None:
            for (t, k), e in self.s.staged.items():
                if t == tier and k.startswith(prefix):
                    rows.pop(k, None)
                    if e["state"] == "Set" and (e["expires"] is None or e["expires"] >= self.s.now_l):
                        rows[k] = Value(e["value"], e["revision"], e["expires"] or 0)
        out = [rows[k] for k in sorted(rows)]
        self.last = ("Get", out, -1)
        if into:
            self.vars[into] = Value(out, 0, 0)


def run_set(script: str, params: DataFrame, log: DataFrame, now_l: int) -> tuple[DataFrame, DataFrame]:
    """One plan for a script over a table of parameters: (results, mutations).

    ``params`` has a row_id and one string column for each placeholder, named
    without its @.  Statements: let, get, exists, if, set, delete, return, throw.
    Each get is a join with the head; all reads see the state before the run.
    """
    head = reads.latest(log, now_l).select(F.col("key").alias("__k"), F.col("value").alias("__v"), F.col("revision").alias("__r"), F.coalesce("expires_l", F.lit(0)).alias("__e"))
    state = {"rows": params, "n": 0}
    env = {f"@{c}": Typed("string", F.col(c)) for c in params.columns if c != "row_id"}
    results: list = []
    writes: list = []

    def run(block: tuple, when, env: dict) -> dict:
        for s in block:
            if s[0] == "let":
                env[s[1]] = compile_node(s[2], env, now_l)
            elif s[0] in ("get", "exists"):
                if s[3] is not None or s[4] is not None:
                    raise ScriptError("set mode reads the latest state")
                n = state["n"] = state["n"] + 1
                right = head.toDF(f"__k{n}", f"__v{n}", f"__r{n}", f"__e{n}")
                key = compile_node(s[2], env, now_l).col
                state["rows"] = state["rows"].withColumn(f"__q{n}", key).join(right, F.col(f"__q{n}") == F.col(f"__k{n}"), "left")
                if s[5]:
                    found = F.col(f"__r{n}")
                    value = Typed("string", F.col(f"__v{n}"), found, F.col(f"__e{n}"))
                    env[s[5]] = value if s[0] == "get" else Typed("bool", F.when(found.isNotNull(), True), found, F.col(f"__e{n}"))
            elif s[0] == "if":
                test = compile_node(s[1], env, now_l)
                ok = F.coalesce(test.col, F.lit(False)) if test.kind == "bool" else F.lit(False)
                a, b = run(s[2], when & ok, dict(env)), run(s[3], when & ~ok, dict(env))
                for k in {*a, *b} - {*env} | {k for k in env if a[k] is not env[k] or b[k] is not env[k]}:
                    x, y = a.get(k), b.get(k)
                    if x and y and x.kind != y.kind and "null" not in (x.kind, y.kind):
                        raise ScriptError(f"{k} has two types")
                    kind = (x or y).kind if not (x and x.kind == "null" and y) else y.kind
                    env[k] = Typed(kind, F.when(ok, x.col if x else F.lit(None)).otherwise(y.col if y else F.lit(None)))
            elif s[0] in ("set", "delete"):
                value = column_text(compile_node(s[3], env, now_l)) if s[0] == "set" else F.lit(None).cast("string")
                flags = dict(s[4]) if s[0] == "set" else {}
                ttl = compile_node(flags["ex"], env, now_l).col if flags.get("ex") else F.lit(0).cast("bigint")
                cmp_value = column_text(compile_node(flags["cmp"], env, now_l)) if flags.get("cmp") else F.lit(None).cast("string")
                cmp_rev = compile_node(flags["cmprev"], env, now_l).col if flags.get("cmprev") else F.lit(None).cast("bigint")
                writes.append((when, s[0].upper(), compile_node(s[2], env, now_l).col, value, "nx" in flags, "xx" in flags, cmp_value, cmp_rev, "norev" in flags, ttl))
            elif s[0] == "return":
                results.append((when, column_text(compile_node(s[1], env, now_l)) if s[1] else F.lit("")))
            elif s[0] == "throw":
                results.append((when, F.raise_error(column_text(compile_node(s[1], env, now_l)))))
            else:
                raise ScriptError(f"{s[0]} is for driver mode")
        return env

    run(parse(script), F.lit(True), env)
    out = F.lit(None).cast("string")
    for when, col in reversed(results):
        out = F.when(when, col).otherwise(out)
    rows = state["rows"]
    emitted = [
        F.when(when, F.struct(F.lit(i).alias("step"), F.lit(op).alias("op"), key.alias("key"), value.alias("value"), F.lit(nx).alias("nx"), F.lit(xx).alias("xx"), cv.alias("cmp_value"), cr.cast("bigint").alias("cmp_rev"), F.lit(norev).alias("norev"), ttl.cast("bigint").alias("ttl_ms")))
        for i, (when, op, key, value, nx, xx, cv, cr, norev, ttl) in enumerate(writes)
    ]
    result = rows.select("row_id", out.alias("result"))
    if not emitted:
        return result, None
    mutations = rows.select("row_id", F.explode(F.filter(F.array(*emitted), lambda x: x.isNotNull())).alias("m"))
    return result, mutations.select((F.col("row_id") * len(emitted) + F.col("m.step")).alias("seq"), "m.op", "m.key", "m.value", "m.nx", "m.xx", "m.cmp_value", "m.cmp_rev", "m.norev", "m.ttl_ms", F.lit(now_l).cast("bigint").alias("ts_l"))
