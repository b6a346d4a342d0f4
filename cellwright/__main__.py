from cellwright.cli import main

raise SystemExit(main())
