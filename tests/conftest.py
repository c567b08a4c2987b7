import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from permscan.schema import RAW_HEADER
from permscan.session import local_session
from permscan.staging import release


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", app="tests", shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    release(session)
    session.stop()


def line(variant, af="1.00E-01", filt="5.00E-01", lrt="2.00E-01", beta="3.00E-01", err="1.00E-01", h2="1.00E-02", notes=""):
    return "\t".join([variant, af, filt, lrt, beta, err, h2, notes])


def write_run(folder, files, header=None):
    """files: name → list of lines, or text to write as it is."""
    folder.mkdir(parents=True, exist_ok=True)
    head = "\t".join(header or RAW_HEADER)
    for name, lines in files.items():
        text = lines if isinstance(lines, str) else "\n".join([head, *lines]) + "\n"
        (folder / f"{name}.txt").write_text(text)
    return str(folder)


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
