from docmill.cli import main

raise SystemExit(main())
