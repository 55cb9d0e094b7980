from rollscan.cli import main

raise SystemExit(main())
