from tracelight.cli import main

raise SystemExit(main())
