import sys

from lapse.plans.cli import main

sys.exit(main())
