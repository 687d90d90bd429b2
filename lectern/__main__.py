from lectern.cli import main

raise SystemExit(main())
