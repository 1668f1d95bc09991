import sys

from lakemill.cli import main

sys.exit(main())
