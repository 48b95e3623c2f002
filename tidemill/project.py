"""New projects, imports of CSV files, and fingerprints of scripts."""

from __future__ import annotations

import hashlib
import hmac
import os

from .sources.infer import declaration, type_name

MARK = "tidemill.toml"
STATIONS = ("Harbour", "Hillside", "Market", "Mill Lane", "Old Town", "Riverside")


def sample_rows(days: int = 2) -> str:
    """Invented readings: the header of the example's type, a row for each station and day."""
    lines = ["station,pm10,pm25,date"]
    for day in range(1, days + 1):
        for k, station in enumerate(STATIONS):
            coarse = 25 + (17 * k + 11 * day) % 50 + (3 * k + day) % 10 / 10
            lines.append(f"{station},{coarse:.1f},{coarse * 0.55:.1f},2025-06-{day:02d}")
    return "\n".join(lines) + "\n"


EXAMPLE = """// tidemill run example.mill
type AirQuality = {
  station: string,
  pm10: float,
  pm25: float,
  date: string,
}

v data = load("data/sample.csv") :: AirQuality

v busiest = data
  |> filter(pm10 > 40)
  |> orderBy("pm10", desc: true)
  |> take(5)
"""


def new(folder: str) -> str:
    """A folder with a sample table and a script that reads it; refuses a folder that exists."""
    os.makedirs(os.path.join(folder, "data"))
    files = {MARK: f'name = "{os.path.basename(os.path.abspath(folder))}"\n', "data/sample.csv": sample_rows(), "example.mill": EXAMPLE, "main.mill": "// Types and pipelines of this project\n"}
    for name, text in files.items():
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def root_of(path: str) -> str | None:
    """The nearest folder above ``path`` with a project file."""
    folder = os.path.abspath(path if os.path.isdir(path) else os.path.dirname(path))
    while not os.path.exists(os.path.join(folder, MARK)):
        up = os.path.dirname(folder)
        if up == folder:
            return None
        folder = up
    return folder


def import_csv(path: str, start: str = ".") -> str:
    """Append the type of a CSV file to the project's main script; returns the block, empty if its type is there already."""
    root = root_of(start)
    if root is None:
        raise FileNotFoundError(f"no {MARK} in this folder or above")
    main = os.path.join(root, "main.mill")
    with open(path, "rb") as f:
        block = declaration(path, f.read())
    have = ""
    if os.path.exists(main):
        with open(main, encoding="utf-8") as f:
            have = f.read()
    if f"type {type_name(path)} " in have:
        return ""
    with open(main, "a", encoding="utf-8") as f:
        f.write("\n" + block)
    return block


def fingerprint(code: str) -> str:
    return hashlib.sha256(code.encode()).hexdigest()


def verified(code: str, expected: str) -> bool:
    return hmac.compare_digest(fingerprint(code), expected.lower())
