"""Reports of test runners other than pytest, and stack traces by language.  One text in, rows out; see `parsers.per_text`."""

from __future__ import annotations

import re

from .parsers import TESTS  # noqa: F401  the rows of all runners

_GO_FAIL = re.compile(r"\s*--- FAIL: (\S+)")
_GO_PLACE = re.compile(r"\s+([\w./-]+\.go):(\d+):")
_GO_EDGE = re.compile(r"\s*(?:---|===)\s")


def go_report(t: str) -> list[tuple]:
    """Failing tests of `go test`.  A test's output comes before its banner: the place is the earliest file.go:n: in the 40 lines
    before, back to the mark of the test before it."""
    out, lines = [], t.split("\n")
    for i, line in enumerate(lines):
        if m := _GO_FAIL.match(line):
            block = []
            for back in reversed(lines[max(0, i - 40) : i]):
                if _GO_EDGE.match(back):
                    break
                block.append(back)
            places = [p for b in block if (p := _GO_PLACE.match(b))]
            file, at = (places[-1][1], int(places[-1][2])) if places else (None, None)
            out.append((m[1], "FAILED", "TestFailure", file, at))
    return out


_CARGO_FAIL = re.compile(r"^test (\S+) \.\.\. FAILED$", re.M)
_CARGO_PANIC = re.compile(r"panicked at (?:'[^\n]*', )?([\w./\\-]+):(\d+)(?::\d+)?")
_CARGO_TOTAL = re.compile(r"^test result: (?:ok|FAILED)\. (\d+) passed; (\d+) failed; (\d+) ignored", re.M)


def cargo_report(t: str) -> list[tuple]:
    """Failing tests of `cargo test`: names and panics stand in different blocks and belong together by their order."""
    places = [(m[1], int(m[2])) for m in _CARGO_PANIC.finditer(t)]
    names = [m[1] for m in _CARGO_FAIL.finditer(t)]
    return [(n, "FAILED", "panic", *(places[k] if k < len(places) else (None, None))) for k, n in enumerate(names)]


CARGO_TOTALS = "passed long, failed long, ignored long, suites long"


def cargo_totals(t: str) -> list[tuple]:
    """Sums over all result lines."""
    found = [tuple(map(int, m.groups())) for m in _CARGO_TOTAL.finditer(t)]
    return [(*map(sum, zip(*found)), len(found))] if found else []


_UNIT_FAIL = re.compile(r"(FAIL|ERROR): (\S+) \(([\w.]+)\)")
_UNIT_FRAME = re.compile(r'\s+File "([^"]+)", line (\d+)')
_UNIT_ERROR = re.compile(r"(\w+(?:\.\w+)*(?:Error|Exception))\b")


def unittest_report(t: str, root: str = "") -> list[tuple]:
    """Failing tests of unittest: the last frame within 60 lines and under `root`, up to the line of the exception.  Newer versions
    name the method in the parentheses, so it is not named twice."""
    out, lines = [], t.split("\n")
    for i, line in enumerate(lines):
        if not (m := _UNIT_FAIL.match(line)):
            continue
        test = m[3] if m[3].split(".")[-1] == m[2] else f"{m[3]}.{m[2]}"
        file = at = error = None
        for ahead in lines[i + 1 : i + 61]:
            if f := _UNIT_FRAME.match(ahead):
                file, at = (f[1][len(root) :], int(f[2])) if f[1].startswith(root) else (None, None)
            elif e := _UNIT_ERROR.match(ahead):
                error = e[1]
                break
        out.append((test, "FAILED" if m[1] == "FAIL" else "ERROR", error or m[1].title(), file, at))
    return out


_JEST_FAIL = re.compile(r"^\s*(?:FAIL|✕|×)\s+(.+)$", re.M)


def jest_report(t: str) -> list[tuple]:
    """Failing files and tests of jest and vitest, each once; they name no line, so none is made up."""
    names = (re.sub(r"\s*\(\d+\s*m?s\)\s*$", "", m[1].strip()) for m in _JEST_FAIL.finditer(t))
    return [(n, "FAILED", "TestFailure", None, None) for n in dict.fromkeys(names) if n and not n.startswith("(")]


JEST_COUNTS = "label string, failed long, passed long, total long"


def jest_counts(t: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"^(Tests|Test Suites):\s+(.+)$", t, re.M):
        n = {k: int(v) for v, k in re.findall(r"(\d+) (failed|passed|total)", m[2])}
        out.append((m[1].lower(), n.get("failed", 0), n.get("passed", 0), n.get("total", 0)))
    return out


# -- stack traces by language -------------------------------------------------------------------------------------

#: Frames: language, pattern with path (or qualified name) and line.
FRAMES = (
    ("python", re.compile(r'\s+File "([^"]+)", line (\d+)')),
    ("java", re.compile(r"\s+at ([\w.$<>]+)\([\w.]+\.(?:java|kt|scala):(\d+)\)")),
    ("rust", re.compile(r"\s+at (\S+\.rs):(\d+):\d+$")),
    ("javascript", re.compile(r"\s+at (?:[^(\n]+ \()?((?:node:)?[^()\s]+?):(\d+):\d+\)?$")),
    ("go", re.compile(r"\t(\S+\.go):(\d+)(?: \+0x[0-9a-f]+)?$")),
)
# Paths and names of libraries and runtimes.
LIBRARY_PATHS = (
    "/site-packages/", "/dist-packages/", "/lib/python3", "<frozen ", "/node_modules/", "/usr/local/go/", "/usr/lib/go", "/go/src/runtime/", "/pkg/mod/",
    "/rustc/", "/.cargo/", "/.rustup/", "/library/std/", "/library/core/", "/library/alloc/", "/lib/x86_64-linux-gnu/", "/lib/ruby/",
)
LIBRARY_STARTS = (
    "node:", "internal/", "<frozen", "<string>", "<stdin>",
    "java.", "javax.", "jakarta.", "jdk.", "sun.", "com.sun.", "kotlin.", "kotlinx.", "scala.",
    "org.springframework.", "org.apache.", "org.hibernate.", "org.postgresql.", "org.mariadb.", "org.eclipse.", "org.jboss.", "org.glassfish.", "org.junit.", "org.slf4j.", "org.mockito.",
    "com.mysql.", "com.zaxxer.", "com.fasterxml.", "com.google.", "com.amazonaws.", "com.microsoft.", "com.oracle.",
    "io.netty.", "io.grpc.", "io.micrometer.", "io.vertx.", "io.reactivex.", "reactor.", "okhttp3.", "okio.", "ch.qos.", "net.sf.", "oracle.jdbc.", "feign.",
    "runtime.", "testing.", "syscall.", "reflect.", "net/http.",
    "std::", "core::", "alloc::", "<std::", "<core::", "<alloc::", "rust_begin_unwind", "__rust",
)
HEADS = (
    ("python", re.compile(r"Traceback \(most recent call last\):")), ("go", re.compile(r"(?:panic: |goroutine \d+ |fatal error: )")), ("rust", re.compile(r"thread '[^']*' (?:\(\d+\) )?panicked at")),
    ("at", re.compile(r"(?:Exception in thread \"[^\"]*\" )?(?:[\w$]+\.)*[A-Z]\w*(?:Error|Exception)\b")),
)
#: How a trace relates to the one before it.
LINKS = (("during", "During handling of the above exception"), ("cause", "The above exception was the direct cause"), ("caused-by", "Caused by: "), ("suppressed", "Suppressed: "))
REPORT = "trace long, language string, link string, frames long, own_frames long, own_place string, error string"


def is_library(place: str) -> bool:
    low = place.lower().replace("\\", "/")
    return place.startswith(LIBRARY_STARTS) or any(m in low for m in LIBRARY_PATHS)


def trace_report(t: str) -> list[tuple]:
    """(trace, language, link to the trace before, frames, frames outside libraries, the nearest of these, error) of each trace.

    Python prints the newest frame and the error last, the others first.  A trace ends with a line that is no frame, or where the
    next begins; at most one source line may stand under a frame.
    """
    out: list[tuple] = []
    frames: list[tuple[str, int]] = []
    language = link = error = None
    waiting = None  # the link that the next trace has

    def close() -> None:
        nonlocal language, link, error
        if frames:
            own = [f"{p}:{n}" for p, n in frames if not is_library(p)]
            near = (own[-1] if language == "python" else own[0]) if own else None
            out.append((len(out), language, link, len(frames), len(own), near, error))
        frames.clear()
        language = link = error = None

    for line in t.split("\n"):
        words = line.strip()
        named = next((n for n, mark in LINKS if words.startswith(mark)), None)
        frame = next(((name, m) for name, rule in FRAMES if (m := rule.match(line))), None)
        if named:
            close()
            if named in ("during", "cause"):
                waiting = named
            else:
                link, error = named, words.split(": ", 1)[1]
        elif frame:
            name, m = frame
            if frames and name != language:
                close()
            language = name
            frames.append((m[1], int(m[2])))
        elif (m := re.match(r"\s*\[Previous line repeated (\d+) more times\]", line)) and frames:
            frames += [frames[-1]] * int(m[1])
        elif head := next((name for name, rule in HEADS if rule.match(words)), None):
            if frames and language == "python" and head == "at" and line[:1].strip():
                error = words
                close()
                continue
            if not (head == "go" and error and not frames):
                close()
                link, waiting = waiting, None
                error = None if head == "python" else words
        elif frames and language == "python" and line and not line[0].isspace():
            error = words
            close()
        elif frames and language != "go" and words and not line[0].isspace():
            close()
    close()
    return out
