import sys

from .plans.terminal import main

sys.exit(main(sys.argv[1:]))
