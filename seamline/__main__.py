"""python -m seamline"""

from seamline.plans.cli import main

raise SystemExit(main())
