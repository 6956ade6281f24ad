"""Clean one stored statement file again: ``python -m tallyloom.plans.rerun FOLDER [FILE] --out FOLDER [--password P]``."""

from __future__ import annotations

import argparse
import sys

from ..session import local_session
from ..sources.files import InvalidPassword, MissingPassword, UnsupportedFile
from ..sources.uploads import clean_name, pick
from .statements import load_statements, normalize_statements


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(description="clean one stored statement file again")
    parser.add_argument("folder")
    parser.add_argument("file", nargs="?")
    parser.add_argument("--out", required=True)
    parser.add_argument("--password")
    args = parser.parse_args(argv)
    spark = spark or local_session()
    try:
        target = pick(spark, args.folder, args.file)
        rows, heads = load_statements(spark, [target], args.password)
        # parsed in tasks: what a file does wrong comes back in Spark's own error
        if not rows.limit(1).count():
            print("no transaction rows in this file")
            return 1
    except (FileNotFoundError, ValueError, UnsupportedFile, MissingPassword, InvalidPassword) as e:
        print(e)
        return 1
    except Exception as e:
        known = next((k for k in ("MissingPassword", "InvalidPassword", "UnsupportedFile") if k in str(e)), None)
        if known is None:
            raise
        print(f"could not read this file: {known}")
        return 1
    out = f"{args.out.rstrip('/')}/{clean_name(target)}"
    clean = normalize_statements(rows)
    clean.write.mode("overwrite").option("header", True).csv(out)
    head = heads.first()
    print(f"{spark.read.option('header', True).csv(out).count()} rows of {head['account_masked'] or 'an unnamed account'} in {out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
