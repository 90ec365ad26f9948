from tarnflow.cli import main

main()
