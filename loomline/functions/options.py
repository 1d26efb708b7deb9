"""What a caller asks for, checked before anything runs."""

from __future__ import annotations

from dataclasses import dataclass

# What a search may look at (the last two are one), and how many sessions are reopened if no number is given.
MODES = ("content", "file", "tool", "everything", "all")
REOPENED = 5


@dataclass(frozen=True)
class Option:
    """wants: whether a value must follow, may, or can't. dashes: a value may begin with this many dashes at most."""

    wants: str = "none"
    dashes: int = 2


class Refused(ValueError):
    """What is wrong with the arguments, in words."""


def parsed(args: list[str], known: dict[str, Option]) -> dict[str, str | None]:
    """Arguments as option -> value. An option that isn't known, or lacks its value, is refused."""
    out: dict[str, str | None] = {}
    rest = list(args)
    while rest:
        name = rest.pop(0)
        option = known.get(name)
        if option is None:
            raise Refused(f"{name} is no option")
        out[name] = None
        if option.wants == "none":
            continue
        value = rest[0] if rest else None
        fits = value is not None and not value.startswith("-" * (option.dashes + 1))
        if fits:
            out[name] = rest.pop(0)
        elif option.wants == "must":
            raise Refused(f"{name} lacks its value")
    return out


#: Options of a search and of reopening; a query may look like anything.
KNOWN = {"--search": Option("must", 1 << 30), "--search-mode": Option("must", 1), "--restore": Option("may", 0), "--list": Option(), "--json": Option()}


def checked(args: list[str], known: dict[str, Option] | None = None) -> dict[str, str | None]:
    """parsed(), and values that make sense together; --restore alone means REOPENED."""
    got = parsed(args, known or KNOWN)
    mode, count = got.get("--search-mode"), got.get("--restore", "1")
    if mode is not None and "--search" not in got:
        raise Refused("--search-mode says how --search looks, and there is no --search")
    if mode is not None and mode not in MODES:
        raise Refused(f"{mode} is none of {', '.join(MODES)}")
    if count is not None and not (count.isascii() and count.isdigit() and int(count) > 0):
        raise Refused(f"{count} is no number of sessions")
    if "--restore" in got and got["--restore"] is None:
        got["--restore"] = str(REOPENED)
    return got
