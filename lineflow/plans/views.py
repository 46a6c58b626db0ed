"""Deterministic line views over the driver's tables, the same text for both engines."""

from __future__ import annotations

from lineflow.functions.dialect import Dialect

LOG = [
    "{t} INFO starting worker {n}", "{t} INFO starting worker {n}", "ERROR: cannot open /home/u/app/src/file{n}.go", "\x1b[31mWARN deprecated call {n}\x1b[0m", "----------------", "", "", "   12%",
    "panic: runtime error {m}", "src/pkg{m}/file.go:{n}: error: undefined: thing", "goroutine {n} [running]:", "step {m} ok", "step {m} ok", "export API_KEY=abc{n}defgh", "https://user:pw{n}x@host/x",
    "docs/error-{n}.html 12 kB", "0 errors found", "TODO: fix it", "=== done ===", "id 6f1e2d3c-1111-2222-3333-44445555{n}99 from 10.0.0.{m} in {n}ms", "[debug] trace {n}", "\tat Object.run ({m})", "json parse error near {m}",
]
COMMANDS = {
    "grep": ["src/a{m}.go:{n}:func run() error", "src/a{m}.go:{n}:return nil", "", "lib/b.py:{n}:x = 1", "ERROR: no {n}", "plain text", "a b.c:{n}:no"],
    "git": ["commit abc{n}", "index a1b2c3..d4e5f6 100644", "old mode 100644", "new mode 100755", "similarity index 9{m}%", "+added {n}", "-removed {m}", "diff --git a/x{m} b/x{m}"],
    "go": ["ok  \tpkg/p{n}\t0.1s", "ok  \tpkg/q{m}\t(cached)", "ok", "--- FAIL: TestA{n}", "FAIL\tpkg/x{m}\t0.2s", "# pkg/h{n}", "    file.go:{n}: bad"],
    "ls": ["total {n}", "-rw-r--r-- 1 u g {n} Jan 1 10:00 file {m}.txt", "drwxr-xr-x 2 u g 4096 Jan 2 11:00 dir{n}", "plain{n}", "short a b"],
    "docker": ["Step {m}/9 : RUN make {n}", "Step 1/9 : FROM base:{m}", " ---> Running in 0a1b2c3d4e{m}", " ---> 0a1b2c3d4e5f", "Removing intermediate container 0a1b", "Pulling from library/x{m}", "0a1b2c3d4e5f: Pull complete", "0a1b2c3d4e5f: Downloading", "\x1b[2K\x1b[1A", "Successfully built {n}", ""],
    "npm": ["npm http fetch {n}", "npm timing x {n}", "npm warn deprecated a@{n}", "npm warn deprecated b@{m}", "added {n} packages", "  Severity: low", "  Path: a{n}", "  Severity: high", "  Patched: v{m}", "[1/4] Resolving packages", "", "{n} vulnerabilities"],
    "node": ["(node:{n}) ExperimentalWarning: x", "(node:{n}) [DEP0{m}] DeprecationWarning: y{n}", " {m}% building", "asset main{n}.js", "    at Module.x (node:internal/a:{n})", "    at app (src/a.js:{m}:1)", "✓ {n} modules", "Need to install {m}", "", "built in {n}ms"],
    "cargo": ["   Compiling a{n} v1.0.{m}", "   Compiling b{m} v0.{n}.0", " Downloading crates", " Downloaded c{n} v1", "warning: unused {n}", "    Finished dev", ""],
    "make": ["make[1]: Entering directory '/x{m}'", "make[1]: Leaving directory '/x{m}'", "make[2]: Nothing to be done for 'all'", "make: *** [x] Error {m}", "gcc -O2 -Wall -c src/f{n}.c -o obj/f{n}.o", "clang++ -o bin/app{m} obj/a.o", "g++ src/m{n}.cpp", "cc -v", "ar rcs lib{m}.a", ""],
    "curl": ["* Connected to h{n}", "* error: refused {n}", "> GET /{n}", "> Host: x", ">", "< HTTP/1.1 200 OK", "< Content-Type: a/b{m}", "< X-Y: {n}", "<", "body {n}", "", "  % Total    % Received", "......"],
    "terraform": ["aws_x.a{n}: Refreshing state... [id={m}]", "aws_x.b: Reading...", "aws_x.b: Read complete after {m}s", "aws_y.c{n}: Still creating... [{m}0s elapsed]", "", "Plan: {n} to add", "  + resource {m}"],
    "ssh": ["Warning: Permanently added 'h{n}' (ED25519) to the list of known hosts.", "debug1: x {n}", "ECDSA key fingerprint is {m}", "#### welcome", "# hi {m} #", "f{n}.txt 100% 12KB 1.2MB/s", "  1,{n} 45% 1.2MB/s 0:00:01", "sent {n} bytes", "", "total {m}"],
    "python": ["Requirement already satisfied: a{n}", "Downloading b{m}.whl (1 MB)", "Collecting c", "x.py:{n}: DeprecationWarning: old", "Successfully installed {m}", "     |████| 12.{m} kB", ""],
    "kubectl": ["metadata:", "  managedFields:", "  - api{n}", "    f:x", "  name: a{m}", "  annotations:", "    kubectl.kubernetes.io/last-applied-configuration: |", "      big{n}", "spec:", "client.go:{m}: debug", ""],
    "tar": ["-rw-r--r-- u/g {n} 2024-01-01 10:00 dir/f{n}", "-rw-r--r-- u/g {n} 2024-01-01 10:00 dir/f{m}", "x dir/a{n}", "x dir/b{m}", "  Length      Date    Time    Name", "---------  ---------- -----", "a.gz:\t 12.{m}% -- created a", "done {n}"],
    "test": ["PASS src/a{n}.test.js", "Tests: {m} failed, {n} passed, {n} total", "Tests: 0 failed, {n} passed, {n} total", "--- FAIL: TestX{n}", "ok  \tpkg/a\t0.{m}s", "test result: ok. {n} passed; 0 failed; x", "running {n}", "Error: boom {n}", "console.error", "    at f (a.js:{n}:{m})", "src/lib/u{m}.go:{n} touched", "warning: w{n}", "==== {m} failed, {n} passed in 2s ====", "Duration  {m}s", "  note {n}", "  note {n}"],
    "nodewarn": ["(node:{n}) Warning: one", "(node:{n}) Warning: two", "(Use `node --trace`)", "  detail", "plain {m}"],
}


def templated(d: Dialect, templates: list[str], run: int = 3, lines: int = 250) -> str:
    """(doc, pos, line): one line per order, documents of `lines` lines, runs of `run` lines of one template."""
    k = "o_orderkey"
    index = f"({d.div(k, str(run))} * {len(templates) - 1} + {d.div(k, '40')} * 3 + case when {k} % 17 = 0 then 1 else 0 end) % {len(templates)}"
    body = d.item(d.array(*map(d.lit, templates)), f"cast({index} as int) + 1")
    n, m = f"cast({d.div(k, '2')} % 97 as varchar(20))", f"cast({k} % 7 as varchar(20))"
    t = f"concat('2024-01-0', {m}, 'T10:00:', cast(10 + {k} % 50 as varchar(20)), 'Z')"
    text = f"replace(replace(replace({body}, '{{n}}', {n}), '{{m}}', {m}), '{{t}}', {t})"
    return f"(select cast({d.div(k, str(lines))} as bigint) as doc, cast({k} % {lines} as bigint) as pos, {text} as line from {d.table('orders')})"


def log_lines(d: Dialect) -> str:
    return templated(d, LOG)


def command_lines(d: Dialect, kind: str, lines: int = 250) -> str:
    return templated(d, COMMANDS[kind], lines=lines)


def documents(d: Dialect) -> str:
    return f"(select doc_id as doc, source, lang, coalesce(text, '') as text from {d.table('documents')})"


def paths(d: Dialect) -> str:
    """(path): slash paths with the shapes that walking and grouping tell apart."""
    dirs = ["src", "src/lib", "node_modules/x", ".git/refs", "docs", ".github", "dist", "vendor/y", "pkg/deep/er"]
    names = ["main.go", "util.py", "yarn.lock", "logo.PNG", "readme.md", "x.Lock", "go.sum", "run.sh", "a.ts"]
    pick = lambda xs, k: d.item(d.array(*map(d.lit, xs)), f"cast({k} as int) + 1")
    where, name = pick(dirs, "p_partkey % 9"), pick(names, f"{d.div('p_partkey', '9')} % 9")
    return f"(select p_partkey as id, concat({where}, '/d', cast({d.div('p_partkey', '81')} % 13 as varchar(20)), '/', cast(p_partkey as varchar(20)), '_', {name}) as path from {d.table('part')})"


def requests(d: Dialect) -> str:
    """(id, us, tool, key, raw_key, max_lines, no_trunc): a request history from the event stream."""
    return f"""(select event_id as id, {d.epoch('ts')} as us, cast(user_id % 40 as bigint) as tool, event_type as key, concat(event_type, ':', cast(event_id % 3 as varchar(20))) as raw_key,
        cast(event_id % 4 * 50 as bigint) as max_lines, event_id % 5 = 0 as no_trunc from {d.table('events')})"""


def measurements(d: Dialect) -> str:
    """(id, us, session, cmd_type, raw_bytes, clean_bytes, raw_tokens, clean_tokens, quality, rerequest) from the events."""
    raw = "(100 + event_id % 977 * 10)"
    clean = f"({d.div(raw + ' * (10 + event_id % 60)', '100')})"
    return f"""(select event_id as id, {d.epoch('ts')} as us, case when user_id % 11 = 0 then '' else concat('s', cast(user_id as varchar(20))) end as session, case when event_id % 13 = 0 then '' else event_type end as cmd_type,
        cast({raw} as bigint) as raw_bytes, cast({clean} as bigint) as clean_bytes, cast({d.div(raw, '4')} as bigint) as raw_tokens, cast({d.div(clean, '4')} as bigint) as clean_tokens,
        {d.double('(event_id % 101)')} as quality, event_id % 7 = 0 as rerequest from {d.table('events')})"""
