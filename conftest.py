"""Lets tests, and Spark's Python workers, import the package from the repository's top."""

import os
import sys

TOP = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, TOP)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [TOP, os.environ.get("PYTHONPATH")]))
