from samelode.cli import main

main()
