"""Command line: ``python -m loomgraph query STORE TOOL [PARAMS]``."""

import sys

from loomgraph.adapters.tools import main

sys.exit(main(sys.argv[1:]))
