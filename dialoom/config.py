"""Settings from the environment and from a file of KEY=value lines; the environment wins. Also: one instance at a time, and logs without texts."""

from __future__ import annotations

import logging
import os
from collections.abc import Mapping, MutableMapping
from dataclasses import dataclass, field, fields
from pathlib import Path

TRUE, FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


def read_env(path: str | Path) -> dict[str, str]:
    """Settings of a file; blank lines, comments and lines without "=" don't count, quotes around a value go. A missing file has none."""
    out: dict[str, str] = {}
    if Path(path).is_file():
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            key, eq, value = line.strip().partition("=")
            if eq and not key.startswith("#"):
                out.setdefault(key.strip(), value.strip().strip('"').strip("'"))
    return out


def load_env(path: str | Path, env: MutableMapping[str, str] | None = None) -> None:
    """Puts a file's settings into the environment where they aren't set."""
    env = os.environ if env is None else env
    for key, value in read_env(path).items():
        env.setdefault(key, value)


def _number(kind: type):
    def parse(name: str, raw: str):
        try:
            value = kind(raw)
        except ValueError as e:
            raise ValueError(f"setting {name} must be a number") from e
        if value <= 0:
            raise ValueError(f"setting {name} must be greater than zero")
        return value

    return parse


def _switch(name: str, raw: str) -> bool:
    low = raw.lower()
    if low not in TRUE | FALSE:
        raise ValueError(f"setting {name} must be true or false")
    return low in TRUE


def _setting(parse, default=None, *, env: str, required: bool = False, secret: bool = False):
    return field(default=default, repr=not secret, metadata={"parse": parse, "env": env, "required": required})


_text = lambda name, raw: raw


@dataclass(frozen=True)
class Settings:
    """All settings, typed; secrets don't show in its repr."""

    owner_id: int = _setting(_number(int), env="OWNER_ID", required=True)
    contact_id: int = _setting(_number(int), env="CONTACT_ID", required=True)
    model: str = _setting(_text, env="MODEL", required=True)
    model_key: str | None = _setting(_text, env="MODEL_KEY", secret=True)
    context_messages: int = _setting(_number(int), 30, env="CONTEXT_MESSAGES")
    timeout_seconds: float = _setting(_number(float), 60.0, env="TIMEOUT_SECONDS")
    behavior_path: str = _setting(_text, "README.md", env="BEHAVIOR_PATH")
    feedback_enabled: bool = _setting(_switch, True, env="FEEDBACK_ENABLED")
    feedback_path: str = _setting(_text, ".runtime/feedback", env="FEEDBACK_PATH")
    saved_messages_enabled: bool = _setting(_switch, False, env="SAVED_MESSAGES_ENABLED")
    prompt_version: str = _setting(_text, "v1", env="PROMPT_VERSION")
    review_enabled: bool = _setting(_switch, False, env="REVIEW_ENABLED")
    review_token: str | None = _setting(_text, env="REVIEW_TOKEN", secret=True)
    reviewer_id: int | None = _setting(_number(int), env="REVIEWER_ID")
    review_chat_id: int | None = _setting(_number(int), env="REVIEW_CHAT_ID")
    export_path: str = _setting(_text, ".runtime/exports", env="EXPORT_PATH")
    export_limit: int = _setting(_number(int), 500, env="EXPORT_LIMIT")
    export_context: int = _setting(_number(int), 10, env="EXPORT_CONTEXT")
    export_redact: bool = _setting(_switch, True, env="EXPORT_REDACT")
    style_enabled: bool = _setting(_switch, True, env="STYLE_ENABLED")
    style_path: str = _setting(_text, ".runtime/style", env="STYLE_PATH")
    style_required: bool = _setting(_switch, True, env="STYLE_REQUIRED")
    style_incremental: bool = _setting(_switch, True, env="STYLE_INCREMENTAL")
    style_batch: int = _setting(_number(int), 50, env="STYLE_BATCH")
    retrieval_limit: int = _setting(_number(int), 8, env="RETRIEVAL_LIMIT")
    rules_chars: int = _setting(_number(int), 12_000, env="RULES_CHARS")
    examples_chars: int = _setting(_number(int), 10_000, env="EXAMPLES_CHARS")
    runtime_path: str = _setting(_text, ".runtime", env="RUNTIME_PATH")

    @classmethod
    def load(cls, env_file: str | Path = ".env", env: Mapping[str, str] | None = None) -> Settings:
        """Settings of the environment (os.environ unless given) over those of the file; a blank value counts as none."""
        seen = {**read_env(env_file), **{k: v for k, v in (os.environ if env is None else env).items()}}
        got = {}
        for f in fields(cls):
            name, raw = f.metadata["env"], seen.get(f.metadata["env"], "").strip()
            if raw:
                got[f.name] = f.metadata["parse"](name, raw)
            elif f.metadata["required"]:
                raise ValueError(f"missing setting: {name}")
        made = cls(**got)
        if made.review_enabled:
            for f, name in (("review_token", "REVIEW_TOKEN"), ("reviewer_id", "REVIEWER_ID")):
                if getattr(made, f) is None:
                    raise ValueError(f"missing setting: {name}")
            if made.review_chat_id not in (None, made.reviewer_id):
                raise ValueError("REVIEW_CHAT_ID must equal REVIEWER_ID: reviews are private")
        return made

    def check_files(self) -> None:
        """An error that names the files that a start needs and that aren't there."""
        needed = [self.behavior_path] + ([f"{self.style_path}/CURRENT"] if self.style_enabled and self.style_required else [])
        missing = [p for p in needed if not Path(p).exists()]
        if missing:
            raise ValueError("missing files: " + ", ".join(missing))


def behavior(path: str | Path, heading: str) -> str:
    """The text below a heading of a Markdown file, up to the next heading; '' where there is none."""
    lines, inside = [], False
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if line.strip().startswith("#"):
            if inside:
                break
            inside = line.strip().lstrip("#").strip().lower() == heading.lower()
        elif inside:
            lines.append(line)
    return "\n".join(lines).strip()


class Instance:
    """One process at a time by a lock file with its number; the lock of a process that has died gives way."""

    def __init__(self, folder: str | Path, name: str = "dialoom"):
        self.path = Path(folder) / f"{name}.lock"

    def __enter__(self) -> Instance:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        for _ in range(2):
            try:
                with open(self.path, "x", encoding="ascii") as f:
                    f.write(str(os.getpid()))
                return self
            except FileExistsError:
                if self._alive():
                    break
                self.path.unlink(missing_ok=True)
        raise RuntimeError(f"already running: {self.path}")

    def _alive(self) -> bool:
        try:
            pid = int(self.path.read_text(encoding="ascii"))
            if pid <= 0:
                return False
            os.kill(pid, 0)
        except (ValueError, ProcessLookupError, FileNotFoundError):
            return False
        except PermissionError:
            return True
        return True

    def __exit__(self, *exc) -> None:
        self.path.unlink(missing_ok=True)


class NoTexts(logging.Filter):
    """Lets through what a log may say: ids, kinds and counts. A record whose arguments hold a text with white space is cut to its message's form."""

    def filter(self, record: logging.LogRecord) -> bool:
        args = record.args if isinstance(record.args, tuple) else ()
        if any(isinstance(a, str) and len(a.split()) > 1 for a in args):
            record.msg, record.args = record.msg.split("%")[0] + "(withheld)", ()
        record.exc_info = None
        return True


def logger(path: str | Path, name: str = "dialoom") -> logging.Logger:
    """A logger to a file, without private texts and without tracebacks."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    handler = logging.FileHandler(path, encoding="utf-8")
    handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
    handler.addFilter(NoTexts())
    log = logging.getLogger(name)
    log.handlers[:] = [handler]
    log.setLevel(logging.INFO)
    log.propagate = False
    return log
