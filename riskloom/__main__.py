from riskloom.cli import main

raise SystemExit(main())
